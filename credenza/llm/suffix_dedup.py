"""Repeated passages by sparse suffix arrays.

A passage is repeated if a run of `length` words (50) occurs elsewhere: in another document or again in the
same one. Suffixes are kept only at minimiser positions: the place whose k-word hash is least among w
consecutive ones (the last on ties), w + k - 1 words together, so that any two occurrences of a passage
have the same retained places in it, the first of them within its first w words. Retained suffixes whose
leading length - w + 1 words occur in no other text are left out by counts of those words' fingerprints.
The rest are sorted by their words over all partitions, and each is compared, word by word, with the one
before and the one after it: the longer of the two common prefixes is the longest it has with any other
suffix, and tells how far its match reaches to the right. To the left a match is extended by up to w - 1
words: each window of `length` words around the suffix that the right match leaves possible is
fingerprinted (96 bits), and windows with equal fingerprints are equal passages. Runs of overlapping windows
form a span. The first occurrence of each window (least id, then least position) is the original; spans
are made of the windows that have an earlier original elsewhere, so one copy of every passage stays.

Scale: equal texts are one text until the end (128 bits of hashes). The suffix order is a range partitioning
by words, text and place together, so that a passage which a third of all documents share is cut over
partitions as well; suffixes at the edge of a partition keep the neighbour they lack as a possible match.
Fingerprints are counted with counts combined before each shuffle; joins of windows to their originals are
plain equi-joins that adaptive execution can split. Texts are shuffled once, by text, and only the words
around candidates a second time.

Defined cases: null, empty and short texts have no spans; very long texts are read whole; repeated rows and
ids: every row but the first (least id; null ids last) of equal texts is a copy of the first; ids may be of
any type and null; an empty table gives an empty result; other columns are not carried by repeats().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import WordIds, drop_saved, mix, partitions, save, slices, texts_of, window_hashes

LENGTH, WINDOW, GRAM = 50, 20, 8
#: Words of a suffix that any two occurrences of a passage have in common from their first retained place on.
LEAD = LENGTH - WINDOW + 1
#: The same words as in common.WORD, on bytes, for their places in a text.
PLACES = re.compile(rb"[^\x20\x09-\x0D]+")


def minimisers(grams: np.ndarray, w: int) -> np.ndarray:
    """The position of the last least hash among each w consecutive ones; it never falls."""
    if len(grams) < w:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.arange(len(grams) - w + 1) + (w - 1 - np.argmin(views, axis=1))


def suffixes(batches):
    """(id, node, mark, text) to one row (id, node, mark, n_words) per document, with the fingerprints of its retained
    suffixes' leads (and of those that occur twice in it), once per task and text."""
    ids, seen = WordIds(), set()
    for batch in batches:
        for part in slices(batch):
            counts, prints, twice = [], [], []
            for key, text in zip(zip(part.column("node").to_pylist(), part.column("mark").to_pylist(), strict=True), texts_of(part), strict=True):
                words = text.split()
                counts.append(len(words))
                if len(words) < LENGTH or key in seen:
                    prints.append(None)
                    twice.append(None)
                    continue
                seen.add(key)
                array = ids.array(words)
                names, n = np.unique(retained(array)[1], return_counts=True)
                prints.append(names.view(np.int64))
                twice.append(names[n > 1].view(np.int64))
            if len(seen) > 500_000:
                seen.clear()
            arrays = [part.column(c) for c in ("id", "node", "mark")] + [pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "node", "mark", "n_words", "prints", "twice"])


def retained(array: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the retained suffixes, the fingerprints of their leads, and the first and last window (by its first
    word) whose minimiser each is. A window's minimiser depends on its own words alone."""
    of_window = minimisers(window_hashes(array, GRAM), WINDOW)[: max(0, len(array) - LENGTH + 1)]
    places, first, n = np.unique(of_window, return_index=True, return_counts=True)
    return places, window_hashes(array, LEAD)[places], first, first + n - 1


def contexts(batches):
    """(id, node, mark, text, prints: of the text's candidate suffixes) to those suffixes: their first LENGTH words, the words
    before them that their windows hold, and the number of those windows."""
    ids = WordIds()
    for batch in batches:
        for part in slices(batch, most=2 << 20):
            rows: list[tuple] = []
            for doc, node, mark, text, prints in zip(*(part.column(c).to_pylist() for c in ("id", "node", "mark")), texts_of(part), part.column("prints").to_pylist(), strict=True):
                words = text.split()
                places, leads, first, last = retained(ids.array(words))
                own = np.isin(leads, np.array(prints, dtype=np.int64).view(np.uint64))
                for at, a, z in zip(places[own].tolist(), first[own].tolist(), last[own].tolist(), strict=True):
                    rows.append((b" ".join(words[at : at + LENGTH]), b" ".join(words[a:at]), at - a, z - a + 1, doc, node, at, mark))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), part.column("id").type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["suffix", "before", "n_before", "n_windows", "least", "node", "at", "mark"])


def common_words(a: bytes, b: bytes) -> int:
    """Number of words at the beginning that a and b (words with one space between them) have in common."""
    if a == b:
        return a.count(b" ") + 1
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common prefix in bytes
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    ends = all(low == len(x) or x[low] == 32 for x in (a, b))
    return a.count(b" ", 0, low) + ends


def neighbours(batches):
    """Suffixes in order to the windows (node, mark, at, print, check, least) that their matches with the one before and the
    one after make possible."""
    ids, last, reach = WordIds(), None, LENGTH
    for batch in batches:
        for part in slices(batch, "suffix", most=1 << 20):
            names = part.schema.names
            rows = list(zip(*(part.column(c).to_pylist() for c in names), strict=True))
            shared = [common_words(a[0], b[0]) for a, b in zip([last, *rows] if last else rows, rows if last else rows[1:], strict=False)]
            # The row before this slice waits for its later neighbour; so does this slice's last row.
            ready = [last, *rows[:-1]] if last else rows[:-1]
            left = [reach, *shared[:-1]] if shared else []
            if ready:
                yield windows_of(ready, [max(x, y) for x, y in zip(left, shared, strict=True)], ids, part.schema.field("least").type)
            last, reach = rows[-1], shared[-1] if shared else LENGTH
    if last:
        yield windows_of([last], [LENGTH], ids, part.schema.field("least").type)


def windows_of(rows: list[tuple], reach: list[int], ids: WordIds, kind: pa.DataType) -> pa.RecordBatch:
    """The windows of suffixes that match another suffix in so many words."""
    words, sizes = [], []
    for suffix, before, n_before, *_ in rows:
        own = (before.split() if n_before else []) + suffix.split()
        sizes.append(len(own))
        words += own
    sizes, n_before, n, at = (np.array(x, dtype=np.int64) for x in (sizes, [r[2] for r in rows], [r[3] for r in rows], [r[6] for r in rows]))
    # Window i of a row holds n_before - i words before the suffix, and so many words less of its match.
    n = np.maximum(0, np.minimum(n, n_before + np.array(reach, dtype=np.int64) - LENGTH + 1))
    row = np.repeat(np.arange(len(rows)), n)
    i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    array = ids.array(words)
    prints, marks = window_hashes(array, LENGTH), window_hashes(mix(array ^ np.uint64(LENGTH)), LENGTH)
    where = (np.cumsum(sizes) - sizes)[row] + i
    taken = row.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[r][5] for r in taken], pa.int64()), pa.array([rows[r][7] for r in taken], pa.int64()), pa.array(at[row] - n_before[row] + i), pa.array(prints[where].view(np.int64)), pa.array((marks[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array([rows[r][4] for r in taken], kind)],
        ["node", "mark", "at", "print", "check", "least"],
    )


def merged(batches):
    """(node, mark, at, o_id, o_at) sorted by them, rows of a text together, to spans of overlapping windows."""
    now, kind = None, None
    for batch in batches:
        rows, kind = [], batch.column("o_id").type
        for node, mark, at, o_id, o_at in zip(*(batch.column(c).to_pylist() for c in ("node", "mark", "at", "o_id", "o_at")), strict=True):
            if now and now[:2] == [node, mark] and at <= now[3]:
                now[3] = at + LENGTH
            else:
                if now:
                    rows.append(now)
                now = [node, mark, at, at + LENGTH, o_id, o_at]
        if rows:
            yield _spans(rows, kind)
    if now:
        yield _spans([now], kind)


def _spans(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.int64()), strict=True)], ["node", "mark", "first_word", "end_word", "o_id", "o_at"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span that is not the first occurrence: id, first_word, end_word (word numbers, the
    end excluded), n_words, of_id and of_word (where the span's first window occurs first)."""
    rows, texts, spans = _located(docs, id_col, text_col)
    every = rows.join(texts.select("node", "mark", "least", "copies"), ["node", "mark"])
    # Equal texts: one row, the least id, stands for the text; of repeated rows of that id too, any but one is a copy.
    lead = every.filter(F.col("id").eqNullSafe(F.col("least"))).groupBy("node", "mark", "id").agg(F.count("*").alias("same"), F.first("n_words").alias("n_words"))
    long = lambda n: F.lit(n).cast("long")
    of_first = lead.join(spans, ["node", "mark"]).select("id", "first_word", "end_word", F.col("o_id").alias("of_id"), F.col("o_at").alias("of_word"))
    again = lead.filter("same > 1").select("id", long(0).alias("first_word"), F.col("n_words").alias("end_word"), F.col("id").alias("of_id"), long(0).alias("of_word"), F.explode(F.sequence(F.lit(2), F.col("same").cast("int"))).alias("x")).drop("x")
    others = every.filter(~F.col("id").eqNullSafe(F.col("least"))).select("id", long(0).alias("first_word"), F.col("n_words").alias("end_word"), F.col("least").alias("of_id"), long(0).alias("of_word"))
    found = of_first.unionByName(others).unionByName(again)
    return found.select(F.col("id").alias(id_col), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "of_id", "of_word")


def _keys(text: Column) -> list[Column]:
    """node and mark: 64 bits each of the text's identity."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("node"), F.xxhash64(F.lit(LENGTH), whole).alias("mark")]


def _located(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts of LENGTH words or more: the rows (id, node, mark, n_words), the texts (node, mark, least id, copies) and the
    spans (node, mark, first_word, end_word, o_id, o_at) of each text but for the first occurrences."""
    narrow = docs.select(F.col(id_col).alias("id"), *_keys(F.col(text_col)), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    read = save(narrow.mapInArrow(suffixes, f"id {kind}, node bigint, mark bigint, n_words bigint, prints array<bigint>, twice array<bigint>"), "suffixes")
    enough = read.filter(F.col("n_words") >= LENGTH)
    texts = save(enough.groupBy("node", "mark").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "texts")
    # Leads that another text has too; a text's own repeats count as well.
    suffix = read.filter("prints IS NOT NULL").select("node", "mark", F.explode("prints").alias("print"))
    texts_with = [f("node") for f in (F.min, F.max)] + [f("mark") for f in (F.min, F.max)]
    shared = suffix.groupBy("print").agg(*[c.alias(n) for c, n in zip(texts_with, ("low", "high", "low2", "high2"), strict=True)]).filter("low <> high OR low2 <> high2").select("print")
    marked = suffix.join(shared, "print").select("node", "mark", "print").unionByName(read.select("node", "mark", F.explode("twice").alias("print")))
    chosen = marked.groupBy("node", "mark").agg(F.collect_set("print").alias("prints")).join(texts, ["node", "mark"]).select(F.col("node").alias("c_node"), F.col("mark").alias("c_mark"), "prints", "least")
    body = narrow.join(chosen, (F.col("node") == F.col("c_node")) & (F.col("mark") == F.col("c_mark")) & F.col("id").eqNullSafe(F.col("least"))).select("id", "node", "mark", "text", "prints")
    candidates = save(body.mapInArrow(contexts, f"suffix binary, before binary, n_before int, n_windows int, least {kind}, node bigint, at bigint, mark bigint"), "candidates")
    order = ["suffix", "node", "mark", "at"]
    ordered = candidates.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = save(ordered.mapInArrow(neighbours, f"node bigint, mark bigint, at bigint, print bigint, check int, least {kind}"), "windows")
    drop_saved(candidates)
    origin = F.min(F.struct(F.col("least").isNull().alias("last"), F.col("least"), F.col("at"), F.col("node"), F.col("mark")))
    first = placed.groupBy("print", "check").agg(F.count("*").alias("n"), origin.alias("o")).filter("n > 1").select("print", "check", F.col("o.node").alias("o_node"), F.col("o.mark").alias("o_mark"), F.col("o.least").alias("o_id"), F.col("o.at").alias("o_at"))
    # Saved, so that the join of a very common window shuffles both sides itself and can be split.
    first = save(first, "first")
    later = placed.join(first, ["print", "check"]).filter((F.col("node") != F.col("o_node")) | (F.col("mark") != F.col("o_mark")) | (F.col("at") != F.col("o_at")))
    # Rows of one text together and in order; texts are many and each is bounded by its own length.
    inside = later.select("node", "mark", "at", "o_id", "o_at").repartition(partitions(docs.sparkSession), "node", "mark").sortWithinPartitions("node", "mark", "at")
    spans = save(inside.mapInArrow(merged, f"node bigint, mark bigint, first_word bigint, end_word bigint, o_id {kind}, o_at bigint"), "spans")
    drop_saved(placed)
    drop_saved(first)
    return enough.select("id", "node", "mark", "n_words"), texts, spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with the words of every repeated span cut out of the text (first occurrences stay); all rows and
    columns. Equal texts keep their words in the row with the least id; rows equal in id and text are
    trimmed alike, as the first. count_col, if present, becomes the new length."""
    _, texts, spans = _located(docs, id_col, text_col)
    of_text = spans.groupBy("node", "mark").agg(F.array_sort(F.collect_set(F.struct("first_word", "end_word"))).alias("spans"))
    cut = texts.join(of_text, ["node", "mark"], "left").filter("copies > 1 OR spans IS NOT NULL").select(F.col("node").alias("c_node"), F.col("mark").alias("c_mark"), "least", "spans")
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_keys(F.col(text_col)))
    joined = rows.join(cut, (F.col("node") == F.col("c_node")) & (F.col("mark") == F.col("c_mark")), "left")
    joined = joined.select("row", "text", F.col("spans"), (F.col("c_node").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))).alias("whole"))
    out = joined.mapInArrow(_trim, f"row {docs.schema.simpleString()}, text string")
    replaced = [F.col("text").alias(c) if c == text_col else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == count_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    return out.select(*replaced)


def _trim(batches):
    """Cuts the spans out of each text, or all of its words."""
    for batch in batches:
        texts = []
        for text, spans, whole in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            if text and (whole or spans):
                places = [m.span() for m in PLACES.finditer(text)]
                kept, at = [], 0
                for first, end in [(0, len(places))] if whole else [(s["first_word"], s["end_word"]) for s in spans]:
                    kept.append(text[at : max(at, places[first][0])])
                    at = max(at, places[min(end, len(places)) - 1][1])
                text = b"".join(kept) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])
