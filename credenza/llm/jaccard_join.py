"""Exact Jaccard self-join on word shingles, and its connected components, by count vectors in R-trees.

Rows with equal shingle sets are one node. Nodes are compared only where they can link: sets of similarity
s or more share a shingle among the first n - ceil(s n) + 1 of each in one global order (frequent shingles
last, then by hash), so nodes are gathered per shared prefix shingle, equal gatherings once. Each node is a
point: its shingles hashed into 512 groups, and the count in each. A gathering's points are packed into an
R-tree (pages by recursive cuts at the median of the coordinate that varies most, then levels of eight
boxes to a box), and each point is sent down the tree: the overlap with a point, or with all that a box holds
(by its greatest coordinates), is at most the summed coordinate minima, and branches below the needed
overlap are cut. Pairs that survive are verified on the texts' shingles, first by hashes, then word by word.

Rounds: first each point proposes only its best earlier partner, and the verified links are joined to
components; then all surviving pairs that still lie in two components are verified. A pair is never
verified if its ends are known to be connected, so large families of near copies cost linear work, and
no other pair is left out: the components are exact. Gatherings of more than CHUNK nodes are worked on in
chunks (each with the first node), and nodes outside the first node's component are then compared with
every chunk.

Nodes are 64-bit hashes (xxh3) of sets of shingle hashes; two different sets with equal hashes would be taken for equal.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are their own component;
fewer than k words are one shingle; repeated rows and ids and null ids are rows of their own (component_id
is the smallest id that is not null, or null); very long texts are read whole; first_of_class() carries all columns, whatever
their names, similarity_classes() none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import drop_saved, partitions, release, save, slices, texts_of, window_hashes, word_hashes
from credenza.llm.graph import components
from credenza.llm.postings import packed, unpacked

GROUPS, LEAF, FANOUT, CHUNK = 512, 32, 8, 1024
#: Points sent down a tree together.
ASKED = 256
#: Postings, and nodes of gatherings, that a group of gather() and of compare() holds, about, however large the input is.
POSTINGS, NODES = 1 << 20, 1 << 14
#: Shingles in this many documents of a slice are reported as frequent; the most frequent are put last in the order.
FREQUENT, MOST_FREQUENT = 8, 100_000


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text's after the other's, and how many each text has."""
    words, counts = word_hashes(texts)
    ends, n = np.cumsum(counts), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    # Runs of k over the whole slice; those that reach into the next text are left out.
    runs, sets = window_hashes(words, k), np.empty(int(n.sum()), dtype=np.uint64)
    firsts = np.cumsum(n) - n
    for a, b, x, m in zip((ends - counts).tolist(), ends.tolist(), firsts.tolist(), n.tolist(), strict=True):
        if b - a >= k:
            sets[x : x + m] = runs[a : a + m]
            sets[x : x + m].sort()
        elif m:
            sets[x] = window_hashes(words[a:b], b - a)[0]
    new = np.r_[True, sets[1:] != sets[:-1]][: len(sets)]
    new[firsts[n > 0]] = True
    left = np.r_[0, np.cumsum(new)]
    return sets[new], left[firsts + n] - left[firsts]


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text."""
    return shingle_sets([text], k)[0]


def node_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of sets of these sizes at this similarity: 100 I >= percent (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def point_of(found: np.ndarray) -> bytes:
    """Shingles per group, in the narrowest unsigned integers that hold them."""
    n = np.bincount((found % np.uint64(GROUPS)).view(np.int64), minlength=GROUPS)
    return n.astype("<u1" if n.max() < 256 else "<u2" if n.max() < 65536 else "<u4").tobytes()


def read_sets(k: int):
    """(id, tkey, text) to one row per document (node, size, counts) and rows of frequent shingles of the slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                every, own_sizes = shingle_sets(texts_of(part), k)
                sizes, at = own_sizes.tolist(), np.r_[0, np.cumsum(own_sizes)].tolist()
                sets = [every[a:b] for a, b in zip(at, at[1:], strict=False)]
                nodes = [node_of(found) if len(found) else None for found in sets]
                counts = [point_of(found) if len(found) else None for found in sets]
                n = len(nodes)
                names, times = np.unique(every, return_counts=True)
                names, times = names[times >= FREQUENT].view(np.int64), times[times >= FREQUENT]
                m = len(names)
                own = pa.array([*range(n), *[None] * m], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(own), part.column("tkey").take(own), pa.array([False] * n + [True] * m), pa.array(nodes + [None] * m, pa.int64()), pa.array(sizes + [0] * m, pa.int64()), pa.array(counts + [None] * m, pa.binary()), pa.array([None] * n + names.tolist(), pa.int64()), pa.array([0] * n + times.tolist(), pa.int64())],
                    ["id", "tkey", "frequent", "node", "n_shingles", "counts", "shingle", "times"],
                )

    return run


def groups(spark, rows: int, most: int) -> int:
    """Groups for so many rows: as many as partitions, or more, so that none holds much more than `most`."""
    return max(partitions(spark), -(-rows // most))


def among(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each is in a sorted table."""
    if not len(table):
        return np.zeros(len(found), dtype=bool)
    return table[np.minimum(np.searchsorted(table, found), len(table) - 1)] == found


def prefix_postings(k: int, percent: int, frequent: np.ndarray, buckets: int):
    """Texts to (bucket, blob of prefix shingles and their nodes); a node is posted once per task as a rule."""

    def run(batches):
        seen = set()
        # The leading bits of the frequent shingles, so that few others are searched for in their table.
        marked = np.zeros(1 << 22, dtype=bool)
        marked[frequent >> np.uint64(42)] = True
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                every, sizes = shingle_sets(texts_of(part), k)
                latest = marked[every >> np.uint64(42)]
                maybe = np.flatnonzero(latest)
                latest[maybe] = among(every[maybe], frequent)
                at = np.r_[0, np.cumsum(sizes)].tolist()
                nodes, prefixes = [], []
                for x, y in zip(at, at[1:], strict=False):
                    if x == y:
                        continue
                    found, late = every[x:y], latest[x:y]
                    node = node_of(found)
                    if node in seen:
                        continue
                    seen.add(node)
                    if late.any():
                        found = np.concatenate([found[~late], found[late]])
                    nodes.append(node)
                    prefixes.append(found[: len(found) - (-(-percent * len(found) // 100)) + 1])
                if len(seen) > 1_000_000:
                    seen.clear()
                if not nodes:
                    continue
                shingle = np.concatenate(prefixes)
                node = np.repeat(np.array(nodes, dtype=np.int64), [len(p) for p in prefixes])
                bucket = (shingle % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((shingle, bucket))
                shingle, node, bucket = shingle[order], node[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(b, packed(shingle[x:y], own, at.astype(np.uint32))) for b, x, y in zip(range(buckets), edges, edges[1:], strict=False) if x < y for own, at in [np.unique(node[x:y], return_inverse=True)]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return run


def gather(most: int):
    """A bucket's postings to the distinct gatherings of two or more nodes, in chunks: (gathering, chunk, chunks, members)."""

    def run(table: pa.Table) -> pa.Table:
        import xxhash

        parts = [(own[0], own[1][own[2]]) for own in (unpacked(b.as_py()) for b in table.column("blob"))]
        shingle, node = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((node, shingle))
        shingle, node = shingle[order], node[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]
        shingle, node = shingle[new], node[new]
        starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        sizes = np.diff(np.r_[starts, len(shingle)])
        found: dict[bytes, None] = {}
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            found[node[a : a + n].tobytes()] = None
        name, chunk, chunks, members = [], [], [], []
        for raw in found:
            own = np.frombuffer(raw, dtype=np.int64)
            # Chunks after the first also hold the first node.
            pieces = [own] if len(own) <= most else [np.r_[own[:1], own[i : i + most]] if i else own[:most] for i in range(0, len(own), most)]
            for i, piece in enumerate(pieces):
                name.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63)), chunk.append(i), chunks.append(len(pieces)), members.append(piece)
        return pa.table({"gathering": pa.array(name, pa.int64()), "chunk": pa.array(chunk, pa.int32()), "chunks": pa.array(chunks, pa.int32()), "members": pa.array(members, pa.list_(pa.int64()))})

    return run


def page_order(points: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The points' numbers, page after page, and where pages begin: cut at the median of the coordinate that varies
    most until a page has LEAF points or fewer."""
    order, starts, open_ = [], [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            starts.append(sum(map(len, order)))
            order.append(own)
            continue
        axis = int(np.argmax(points[own].var(axis=0)))
        own = own[np.argsort(points[own, axis], kind="stable")]
        open_ += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(order), starts


class RTree:
    """Points (counts) in pages, and levels of boxes over them; a box knows the greatest coordinates and the least size
    of what it holds."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order, starts = page_order(points)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.ends = np.r_[starts[1:], len(points)].astype(np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        boxes, least = (np.maximum.reduceat(self.points, starts, axis=0), np.minimum.reduceat(self.sizes, starts)) if len(points) else (points, sizes)
        self.levels = [(boxes, least)]
        while len(boxes) > FANOUT:
            cuts = np.arange(0, len(boxes), FANOUT)
            boxes, least = np.maximum.reduceat(boxes, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((boxes, least))

    def search_all(self, points: np.ndarray, sizes: np.ndarray, percent: int, apart=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sends all points down the tree together: of each pair that may link the asked point's number (ascending), the
        found one's, and their overlap bound. apart(asked, found): which pairs of numbers to look at (default: all)."""
        top = len(self.levels[-1][0])
        asked, found = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes, least = self.levels[depth]
            good = overlaps(points, asked, boxes, found) >= needed(least[found], sizes[asked], percent)
            asked, found = asked[good], found[good]
            if depth:
                asked, found = np.repeat(asked, FANOUT), (found[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                good = found < len(self.levels[depth - 1][0])
                asked, found = asked[good], found[good]
        held = self.ends[found] - self.starts[found]
        asked, at = np.repeat(asked, held), np.arange(held.sum()) + np.repeat(self.starts[found] - np.cumsum(held) + held, held)
        need = needed(self.sizes[at], sizes[asked], percent)
        # An overlap is at most the smaller size.
        good = np.minimum(self.sizes[at], sizes[asked]) >= need
        if apart is not None:
            good &= apart(asked, self.order[at])
        asked, at, need = asked[good], at[good], need[good]
        bounds = overlaps(points, asked, self.points, at)
        good = bounds >= need
        return asked[good], self.order[at[good]], bounds[good]

    def search(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points that may link with this one, and their overlap bounds."""
        return self.search_all(point[None], np.array([size]), percent)[1:]


def overlaps(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: int = 1024) -> np.ndarray:
    """Summed coordinate minima of a[i] and b[j], pair by pair."""
    found = np.empty(len(i), dtype=np.int64)
    for x in range(0, len(i), most):
        found[x : x + most] = np.minimum(a[i[x : x + most]], b[j[x : x + most]]).sum(axis=1, dtype=np.uint32)
    return found


def points_of(raw: list[bytes]) -> np.ndarray:
    """Points of point_of(), in the widest of their integers."""
    width = max(map(len, raw)) // GROUPS
    return np.frombuffer(b"".join(r if len(r) == width * GROUPS else np.frombuffer(r, f"<u{len(r) // GROUPS}").astype(f"<u{width}").tobytes() for r in raw), f"<u{width}").reshape(-1, GROUPS)


def compare(percent: int, forest: bool):
    """Rows (gathering, side, node, size, counts, comp) of a bucket's gatherings to candidate pairs (a, b).

    side 0: all pairs among the members; if a gathering has side 1, pairs between side 1 and side 0 only.
    forest: for each member only its best earlier partner; and (a, null) for every other node with a partner.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gathering", "ascending"), ("side", "ascending"), ("node", "ascending")])
        name, side, node, size, comp = (table.column(c).to_numpy() for c in ("gathering", "side", "node", "size", "comp"))
        counts = table.column("counts")
        pairs: set[tuple[int, int]] = set()
        alone: set[int] = set()
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def settle():
            """Pairs of the hits so far: rows of the table that were asked, rows found and overlap bounds."""
            asked, hits, bounds = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            if not forest:
                pairs.update(zip(np.minimum(node[asked], node[hits]).tolist(), np.maximum(node[asked], node[hits]).tolist(), strict=True))
                return
            before = node[hits] < node[asked]
            alone.update(node[np.setdiff1d(asked, asked[before])].tolist())
            asked, hits, bounds = asked[before], hits[before], bounds[before]
            order = np.lexsort((-(bounds / (size[asked] + size[hits] - bounds)), asked))
            best = order[np.flatnonzero(np.diff(asked[order], prepend=-1))]
            pairs.update(zip(node[hits[best]].tolist(), node[asked[best]].tolist(), strict=True))

        starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.empty(0, dtype=np.int64)
        # Gatherings whose nodes are all in one component have nothing left to compare.
        open_ = np.bitwise_or.reduceat(comp != np.repeat(comp[starts], np.diff(np.r_[starts, len(name)])), starts) if len(starts) else []
        for a, b, compared in zip(starts.tolist(), [*starts[1:].tolist(), len(name)], open_, strict=False):
            if not compared:
                continue
            points, rows = points_of(counts[a:b].to_pylist()), np.arange(a, b)
            inner = rows[side[a:b] == 0]
            tree = RTree(points[inner - a], size[inner])
            every = rows[side[a:b] != 0] if len(inner) < len(rows) else rows
            for i in range(0, len(every), ASKED):
                own = every[i : i + ASKED]
                asked, hits, bounds = tree.search_all(points[own - a], size[own], percent, lambda i, x, own=own, inner=inner: comp[own[i]] != comp[inner[x]])
                if len(asked):
                    waiting.append((own[asked], inner[hits], bounds))
                    held += len(asked)
            # All hits of a node in a gathering are settled together.
            if held > 1 << 19:
                settle()
                held = 0
        if waiting:
            settle()
        rows = [*pairs, *((x, None) for x in alone)]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    return run


def similar(a: np.ndarray | set, b: np.ndarray | set, percent: int) -> bool:
    both = len(a & b) if isinstance(a, set) else len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(k: int, percent: int):
    """(a, b, text_a, text_b), texts compressed, to the pairs whose shingle sets are similar enough: hashes of shingles
    leave few pairs, whose shingles are compared themselves."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        hashed, whole = OrderedDict(), OrderedDict()

        def of(node: int, text: bytes, kept: OrderedDict, make):
            found = kept.get(node)
            if found is None:
                found = kept[node] = make(unpack(text))
                if len(kept) > 64:
                    kept.popitem(last=False)
            return found

        def words(text: bytes) -> set[bytes]:
            own = text.lower().split()
            n = min(k, len(own))
            return {b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}

        for batch in batches:
            keep = []
            for i, (x, y, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)):
                if similar(of(x, s, hashed, lambda v: shingles(v, k)), of(y, t, hashed, lambda v: shingles(v, k)), percent) and similar(of(x, s, whole, words), of(y, t, whole, words), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def compressed(batches):
    """(node, text) to (node, compressed text)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(map(pack, texts_of(part)), pa.binary())], ["node", "text"])


def _candidates(tasks: DataFrame, nodes: DataFrame, comps: DataFrame | None, percent: int, forest: bool) -> DataFrame:
    """tasks: gathering, side, node. Distinct candidate pairs a < b (and b null, see compare())."""
    buckets = groups(tasks.sparkSession, tasks.count(), NODES)
    known = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else nodes.withColumn("comp", F.col("node"))
    rows = tasks.join(known, "node").select("gathering", "side", "node", "size", "counts", "comp")
    return rows.groupBy(F.pmod("gathering", F.lit(buckets)).alias("bucket")).applyInArrow(compare(percent, forest), "a bigint, b bigint").dropDuplicates()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.filter("b IS NOT NULL").select(F.col("b").alias("node"))).dropDuplicates()


def _texts(narrow: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, compressed text of one of its rows) of the wanted nodes."""
    rows = nodes.join(wanted, "node").select("node", F.col("o.id").alias("w_id"), F.col("o.tkey").alias("w_tkey"))
    joined = narrow.join(rows, (F.col("tkey") == F.col("w_tkey")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text")
    return save(joined.mapInArrow(compressed, "node bigint, text binary").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    whole = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(verify(k, percent), "a bigint, b bigint")


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, tkey, node, n_shingles), node null for an empty set; and nodes (node, o, comp): o is the first of the
    node's rows (no_id, id, tkey), by id, null ids last; comp names its component."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    read = save(narrow.mapInArrow(read_sets(k), f"id {kind}, tkey bigint, frequent boolean, node bigint, n_shingles bigint, counts binary, shingle bigint, times bigint"), "sets")
    top = read.filter("frequent").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r[0] for r in top.select("shingle").collect()], dtype=np.int64).view(np.uint64))
    rows = read.filter("NOT frequent")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tkey"))).alias("o")
    nodes = save(rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("counts").alias("counts"), first), "nodes")
    n = F.col("n_shingles")
    prefixes = rows.filter("node IS NOT NULL").agg(F.sum(n - F.ceil(percent * n / 100) + 1)).first()[0] or 0
    buckets = groups(spark, int(prefixes), POSTINGS)
    postings = narrow.select("text").mapInArrow(prefix_postings(k, percent, frequent, buckets), "bucket int, blob binary")
    gathered = postings.groupBy("bucket").applyInArrow(gather(chunk), "gathering bigint, chunk int, chunks int, members array<bigint>")
    gathered = save(gathered.groupBy("gathering", "chunk").agg(F.first("chunks").alias("chunks"), F.first("members").alias("members")), "gathered")
    release(spark)
    task = F.xxhash64("gathering", "chunk")
    inside = gathered.select(task.alias("gathering"), F.lit(0).alias("side"), F.explode("members").alias("node"))
    points = nodes.select("node", "size", "counts")
    proposed = save(_candidates(inside, points, None, percent, True), "proposed")
    release(spark)
    # Texts of the nodes that have a possible partner: one row's text per node, compressed.
    texts = _texts(narrow, nodes, _ends(proposed))
    links = save(_verified(proposed.filter("b IS NOT NULL"), texts, k, percent), "links")
    drop_saved(proposed)
    release(spark)
    comps = components(links)
    rest = _candidates(inside, points, comps, percent, False)
    more = save(_verified(rest, texts, k, percent), "links")
    drop_saved(comps)
    release(spark)
    every = links.unionByName(more)
    spent = [gathered, texts, links, more]
    if gathered.filter("chunks > 1").limit(1).count():
        # Nodes of a chunked gathering outside the first node's component, against every chunk.
        comps = save(components(every), "components")
        large = gathered.filter("chunks > 1")
        heads = large.filter("chunk = 0").select("gathering", F.element_at("members", 1).alias("node")).join(comps, "node", "left").select("gathering", F.coalesce("comp", "node").alias("head"))
        member = large.select("gathering", F.explode("members").alias("node")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        outside = member.join(heads, "gathering").filter("comp <> head").select("gathering", "node").dropDuplicates().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))
        task = F.xxhash64("gathering", "chunk", "part")
        parts = outside.select("gathering", "part").dropDuplicates()
        across = large.join(parts, "gathering").select(task.alias("gathering"), F.lit(0).alias("side"), F.explode("members").alias("node"))
        asked = outside.join(large.select("gathering", "chunk"), "gathering").select(task.alias("gathering"), F.lit(1).alias("side"), "node")
        pairs = save(_candidates(across.unionByName(asked), points, comps, percent, False), "proposed")
        # Nodes without a possible partner in their own chunk have no text yet.
        later = _texts(narrow, nodes, _ends(pairs).join(texts, "node", "left_anti"))
        last = save(_verified(pairs, texts.unionByName(later), k, percent), "links")
        every = every.unionByName(last)
        spent += [comps, pairs, later, last]
    comps = components(every)
    # The classes are made of nodes, rows and components alone.
    for done in spent:
        drop_saved(done)
    release(spark)
    classes = nodes.select("node", "o").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return rows.select("id", "tkey", "node", "n_shingles"), classes


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_shingles and component_id (the smallest id reachable by links, its own included)."""
    rows, classes = _classes(docs, k, percent, id_col, text_col, chunk)
    least = classes.groupBy("comp").agg(F.min("o.id").alias("component"))
    by_node = classes.select("node", "comp").join(least, "comp").select("node", "component")
    out = rows.join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def first_of_class(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each class, with all columns: that with the least id (null ids last), of rows with that id the
    one with the least hash of its text, of rows equal in both the one whose columns, as JSON, come first. Rows without
    words are classes of their own."""
    rows, classes = _classes(docs, k, percent, id_col, text_col, CHUNK)
    firsts = classes.groupBy("comp").agg(F.min("o").alias("o")).select("o.id", "o.tkey")
    wanted = rows.filter("node IS NOT NULL").join(firsts.select(F.col("id").alias("f_id"), F.col("tkey").alias("f_tkey")), (F.col("tkey") == F.col("f_tkey")) & F.col("id").eqNullSafe(F.col("f_id")))
    counted = wanted.groupBy("id", "tkey").agg(F.count("*").alias("n"))
    empty = rows.filter("node IS NULL").select("id", "tkey").dropDuplicates().select("id", "tkey", F.lit(1).cast("long").alias("n"))
    chosen = counted.unionByName(empty).select(F.col("id").alias("f_id"), F.col("tkey").alias("f_tkey"), "n")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"))
    kept = whole.join(chosen, (F.col("tkey") == F.col("f_tkey")) & F.col("id").eqNullSafe(F.col("f_id")))
    # Rows equal in id and text: few as a rule; the least of them, combined before the shuffle.
    again = kept.filter("n > 1").groupBy("id", "tkey").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter("n = 1").select("row.*").unionByName(again.select("row.*"))
