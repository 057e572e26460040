"""Benchmark decontamination over a distributed positional inverted index.

Indexing: documents are cut into segments of some megabytes, in which words have positions in one run of numbers, with
a place left free after every document. A row of the index is one term of one segment: how often it occurs, and its
positions, as differences of variable length. Rows of documents (id, words, first position) lie beside them. The index is
written once, sorted by nothing but the order of reading, and nothing of it is shuffled.

Searching: items are cut into windows of ten words (an item with fewer is one window). The terms of each distinct window
are ordered by how often the index holds them; a window with a term that nowhere occurs is done. Then lists are
intersected from the rarest term on, each adjusted by the term's offset in the window, so that a place that is in all of
them is where the window starts. In the first step only lists of terms that are among the two rarest of a window
are brought together by segment, with the windows whose rarest term a segment holds; in the second, the other lists of windows
that still have a place. With a slack, a term may lie up to so many words off its place (a proximity match); without, matches are exact.

Scale: a term that is in all documents is as many rows as segments, each bounded by a segment. Joins are by (segment, term)
or by term with few rows on the other side, and may be split. A segment's lists are in one task's memory (some megabytes, or
the longest document), its windows pass by in batches. Which windows match is returned by document, and the items of windows are
joined afterwards. No table is broadcast but where Spark has seen its size.

Defined cases: null, empty and blank texts have no words and no items; very long texts are one segment each; repeated rows and
ids, null ids: a result per row; of repeated items one id counts once, and a null item id is spelled as the empty text;
extra columns are not carried; with an empty table of items nothing is hit, and an empty table of documents gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import partitions, save, slices
from credenza.llm.postings import block_number

#: What lies between words, and the length of a window.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Free places after a document, so that no match passes from one to the next: the greatest slack.
GAP = 16
#: Bytes of a segment's texts, about.
SEGMENT = 4 << 20
#: Bytes: A-Z to a-z, all ASCII but digits and letters to spaces, others as they are.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Starts that are looked at at once.
AT_ONCE = 1 << 18


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Unsigned integers in groups of seven bits, the last of each marked by its high bit; and the bytes that each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28, 35):
        sizes += values >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[(ends - sizes)[own] + k] = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[ends - 1] |= 128
    return out.tobytes(), sizes


def unpacked(raw: bytes) -> np.ndarray:
    """The integers of packed(), one after the other."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data >= 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    sizes = ends - starts + 1
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[own] |= (data[starts[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


def differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each value less the one before it; a run's first value (at starts) stays."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def summed(steps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of differences()."""
    total = np.cumsum(steps)
    return total - np.repeat((total - steps)[starts], sizes)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of texts, and each text's number of words."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    joined = b"".join(texts.to_pylist()).translate(FOLDED)
    offsets = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)])
    cut = pc.split_pattern(array, b" ")
    words = cut.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.r_[0, np.cumsum(full)]
    counts = np.diff(before[cut.offsets.to_numpy()])
    return words.filter(pa.array(full)), counts


INDEX = "segment bigint, term binary, n bigint, postings binary, first bigint, id {kind}"


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to the rows of segments."""
    counter = [0]
    for batch in batches:
        for part in slices(batch, most=SEGMENT):
            segment = block_number(counter)
            words, counts = terms_of(part.column("text"))
            first = np.cumsum(counts + GAP) - counts - GAP
            kind = part.column("id").type
            names = ["segment", "term", "n", "postings", "first", "id"]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), pa.nulls(n, pa.binary()), pa.array(counts), pa.nulls(n, pa.binary()), pa.array(first), part.column("id")], names)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            place = np.arange(len(codes)) + np.repeat(GAP * np.arange(n), counts)
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes)
            starts = np.cumsum(sizes) - sizes
            raw, widths = packed(differences(place[order], starts))
            lengths = np.add.reduceat(widths, starts)
            m = len(sizes)
            for a in range(0, m, 20_000):
                z = min(m, a + 20_000)
                low = int(lengths[:a].sum())
                offsets = np.r_[0, np.cumsum(lengths[a:z])].astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(raw[low : low + int(offsets[-1])])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, segment)), coded.dictionary[a:z].cast(pa.binary()), pa.array(sizes[a:z]), blob, pa.nulls(z - a, pa.int64()), pa.nulls(z - a, kind)], names)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a table of documents, in the shared folder: rows of terms (term not null: segment, term, n, postings)
    and rows of documents (term null: segment, first position, n words, id)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return save(narrow.mapInArrow(indexed, INDEX.format(kind=narrow.schema["id"].dataType.simpleString())), "index")


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), BETWEEN), lambda w: w != "")


def windows_of(items: DataFrame, length: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window, words) of a table of items, and whose they are: (item, window)."""
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (length - 1))))
    each = save(cut.select("item", "all", at.alias("i")).select("item", F.slice("all", F.col("i"), length).alias("words")).distinct(), "item-windows")
    windows = save(each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, each.join(windows, "words").select("item", "window")


def ranked(windows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms that the index has (term, t), and windows all of whose terms it has: (window, ts, offsets), rarest first."""
    spelled = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")).withColumn("term", F.col("word").cast("binary"))
    wanted = save(spelled.select("term").distinct(), "wanted")
    counts = index.filter("term IS NOT NULL").select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("total"))
    terms = save(counts.withColumn("t", F.monotonically_increasing_id()), "terms")
    order = F.sort_array(F.collect_list(F.struct("total", "t", "at")))
    whole = spelled.join(terms, "term").groupBy("window", "length").agg(order.alias("o")).filter(F.size("o") == F.col("length"))
    return terms, save(whole.select("window", F.col("o.t").alias("ts"), F.col("o.at").alias("offsets")), "ranked")


STREAM = ("segment", "kind", "key", "length", "bytes", "ts", "offsets")


class Segment:
    """The lists and documents of one segment."""

    def __init__(self):
        self.keys, self.blobs, self.first, self.n, self.keyed = [], [], [], [], None

    def close(self) -> None:
        """Lists in the order of their terms, each position as one number of list and place."""
        order = np.argsort(np.array(self.keys, dtype=np.int64), kind="stable")
        self.terms = np.array(self.keys, dtype=np.int64)[order]
        blobs = [self.blobs[i] for i in order.tolist()]
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        ends = np.cumsum(np.r_[0, raw >= 128])[np.cumsum([0, *map(len, blobs)])]
        self.sizes, self.starts = np.diff(ends), ends[:-1]
        self.places = summed(unpacked(raw.tobytes()), self.starts, self.sizes) if len(blobs) else np.empty(0, dtype=np.int64)
        self.keyed = (np.repeat(np.arange(len(blobs)), self.sizes) << 40) + self.places
        by_first = np.argsort(np.array(self.first, dtype=np.int64))
        self.doc_first, self.doc_n = np.array(self.first, dtype=np.int64)[by_first], np.array(self.n, dtype=np.int64)[by_first]
        self.blobs = []

    def list_of(self, t: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 where the segment has none."""
        at = np.minimum(np.searchsorted(self.terms, t), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == t, at, -1) if len(self.terms) else np.full(len(t), -1)

    def near(self, lists: np.ndarray, places: np.ndarray, slack: int) -> np.ndarray:
        """Whether each list has a position within the slack of each place."""
        low = (lists << 40) + np.maximum(0, places - slack)
        at = np.searchsorted(self.keyed, low)
        found = at < len(self.keyed)
        found[found] = self.keyed[at[found]] <= (lists[found] << 40) + places[found] + slack
        return found & (lists >= 0)


def survivors(segment: Segment, ts: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, blobs: list[bytes | None], least: int, most: int, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows (by row) and starts that are left after the lists of the terms from `least` to `most` in rank.

    ts, offsets: of the rows one after the other, `sizes` of each; blobs: starts so far, None where all places of the
    rarest term's list are to be tried."""
    begins = np.cumsum(sizes) - sizes
    if least == 0:
        lists = segment.list_of(ts[begins])
        counts = np.where(lists >= 0, segment.sizes[lists], 0) if len(segment.sizes) else np.zeros(len(lists), dtype=np.int64)
    else:
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        bounds = np.cumsum(np.r_[0, raw >= 128])[np.cumsum([0, *map(len, blobs)])]
        counts = np.diff(bounds)
        known = summed(unpacked(raw.tobytes()), bounds[:-1], counts)
    ends = np.cumsum(counts)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        own = counts[a:z]
        row = np.repeat(np.arange(a, z), own)
        if least == 0:
            within = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            start = segment.places[np.repeat(segment.starts[lists[a:z]], own) + within] - offsets[begins[row]] if len(row) else np.empty(0, dtype=np.int64)
            row, start = row[start >= 0], start[start >= 0]
        else:
            start = known[bounds[a] : bounds[z]]
        for k in range(max(1, least), min(most, int(sizes[a:z].max(initial=0)))):
            has = sizes[row] > k
            at = begins[row[has]] + k
            keep = np.ones(len(row), dtype=bool)
            keep[has] = segment.near(segment.list_of(ts[at]), start[has] + offsets[at], slack)
            row, start = row[keep], start[keep]
        yield row, start
        a = z


def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Segment, pa.RecordBatch | None]]:
    """A segment's number and lists, with its windows in batches, and None once they are through."""
    now, segment = None, Segment()
    for batch in batches:
        number, kind = (batch.column(c).to_numpy() for c in ("segment", "kind"))
        edges = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]), True]) if len(number) else []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(int(a), int(z - a))
            if number[a] != now:
                if now is not None:
                    yield now, segment, None
                now, segment = int(number[a]), Segment()
            if kind[a] == 2:
                if segment.keyed is None:
                    segment.close()
                yield now, segment, part
            elif kind[a] == 1:
                segment.keys += part.column("key").to_pylist()
                segment.blobs += part.column("bytes").to_pylist()
            else:
                segment.first += part.column("key").to_pylist()
                segment.n += part.column("length").to_pylist()
    if now is not None:
        yield now, segment, None


def arrays_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    ts = part.column("ts")
    return ts.flatten().to_numpy(), part.column("offsets").flatten().to_numpy(), np.diff(ts.offsets.to_numpy()), part.column("bytes").to_pylist()


def first_step(slack: int):
    """Segments' streams to (segment, window, ts, offsets, starts) that the two rarest terms leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, segment, part in by_segment(batches):
            if part is None:
                continue
            for row, start in survivors(segment, *arrays_of(part), 0, 2, slack):
                if not len(row):
                    continue
                order = np.lexsort((start, row))
                row, start = row[order], start[order]
                rows, begins = np.unique(row, return_index=True)
                raw, widths = packed(differences(start, begins))
                offsets = np.r_[0, np.cumsum(np.add.reduceat(widths, begins))].astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column("segment"), kept.column("key"), kept.column("ts"), kept.column("offsets"), blob], ["segment", "window", "ts", "offsets", "starts"])

    return run


def second_step(slack: int):
    """Segments' streams, documents and survivors, to documents with matches: (segment, first, n_hit, windows, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for number, segment, part in by_segment(batches):
            if part is not None:
                windows = part.column("key").to_numpy()
                ts, offsets, sizes, blobs = arrays_of(part)
                for row, start in survivors(segment, ts, offsets, sizes, blobs, 2, len(ts), slack):
                    doc = np.searchsorted(segment.doc_first, start, side="right") - 1
                    inside = start + sizes[row] <= segment.doc_first[doc] + segment.doc_n[doc]
                    found.append(np.stack([doc, start, windows[row], sizes[row]])[:, inside])
            elif found:
                yield from by_document(number, segment, np.concatenate(found, axis=1))
                found = []

    return run


def by_document(number: int, segment: Segment, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document with a match: words inside one, the matching windows, and each match's window and first word."""
    if not found.shape[1]:
        return
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    doc, start, window, size = found
    total = int((segment.doc_first + segment.doc_n).max()) + 1
    inside = np.cumsum(np.bincount(start, minlength=total + 1) - np.bincount(start + size, minlength=total + 1)) > 0
    before = np.r_[0, np.cumsum(inside)]
    docs, begins = np.unique(doc, return_index=True)
    first = segment.doc_first[docs]
    n_hit = before[first + segment.doc_n[docs]] - before[first]
    lists = np.r_[begins, len(doc)].astype(np.int32)
    windows, places = (pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (window, start - segment.doc_first[doc]))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number)), pa.array(first), pa.array(n_hit), windows, places], ["segment", "first", "n_hit", "windows", "places"])


def search(index: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    """Documents with matches: (segment, first, n_hit, windows, places), the last two of the same length: each match's
    window and its first word in the document. slack 0: exact phrases; else the rarest term of a window is at its place and
    every other up to so many words (GAP at most) off its own, in any order."""
    if not 0 <= slack <= GAP:
        raise ValueError(f"slack is 0 to {GAP}")
    terms, order = ranked(windows, index)
    lists = index.filter("term IS NOT NULL").select("segment", "term", "postings").join(terms.select("term", "t"), "term").select("segment", "t", "postings")
    tried = save(lists.select("segment", "t").join(order.withColumn("t", F.col("ts")[0]), "t").select("segment", "window", "ts", "offsets"), "tried")

    def stream(rows: DataFrame, starts: Column, least: int, most: int, more: DataFrame | None = None) -> DataFrame:
        """Lists of the terms that the step asks for, and rows, those of a segment together and lists first."""
        asked = (order if least == 0 else rows).select(F.explode(F.slice("ts", least + 1, most)).alias("t")).distinct()
        own = lists.join(asked, "t", "left_semi")
        none = F.lit(None)
        parts = own.select("segment", F.lit(1).alias("kind"), F.col("t").alias("key"), none.cast("bigint").alias("length"), F.col("postings").alias("bytes"), none.cast("array<bigint>").alias("ts"), none.cast("array<int>").alias("offsets"))
        parts = parts.unionByName(rows.select("segment", F.lit(2).alias("kind"), F.col("window").alias("key"), none.cast("bigint").alias("length"), starts.alias("bytes"), "ts", "offsets"))
        if more is not None:
            parts = parts.unionByName(more.select("segment", F.lit(0).alias("kind"), F.col("first").alias("key"), F.col("n").alias("length"), none.cast("binary").alias("bytes"), none.cast("array<bigint>").alias("ts"), none.cast("array<int>").alias("offsets")))
        return parts.repartition(partitions(rows.sparkSession), "segment").sortWithinPartitions("segment", "kind")

    left = save(stream(tried, F.lit(None).cast("binary"), 0, 2).mapInArrow(first_step(slack), "segment bigint, window bigint, ts array<bigint>, offsets array<int>, starts binary"), "survivors")
    documents = index.filter("term IS NULL").select("segment", "first", "n").join(left.select("segment").distinct(), "segment")
    matched = stream(left, F.col("starts"), 2, 1 << 30, documents).mapInArrow(second_step(slack), "segment bigint, first bigint, n_hit bigint, windows array<bigint>, places array<bigint>")
    return save(matched, "matched")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit (words inside a match), n_items, items_sha256 (of the sorted ids of matching items,
    with commas between them), contaminated."""
    windows, links = windows_of(items, length, item_col, item_text_col)
    index = build(docs, id_col, text_col)
    matched = search(index, windows, slack)
    pairs = matched.select("segment", "first", F.explode(F.array_distinct("windows")).alias("window")).join(links, "window").select("segment", "first", "item").distinct()
    of_doc = pairs.groupBy("segment", "first").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = matched.select("segment", "first", "n_hit").join(of_doc, ["segment", "first"])
    rows = index.filter("term IS NULL").select("segment", "first", F.col("n").alias("n_words"), F.col("id").alias(id_col))
    joined = rows.join(hit, ["segment", "first"], "left")
    ids = F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(id_col, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
