"""Product-quantised codes of vectors, trained by a tree aggregate over columnar NumPy blocks.

Each component becomes the integer floor(256 x); a vector is cut into equal consecutive parts, and each part position
has a codebook. Kept vectors are stored once as blocks: the ids and labels of some thousand vectors and their
components, column after column. A round of training is one RDD treeAggregate over the blocks: the distances of
all vectors of a block to the entries of a part's codebook add up dimension by dimension, every part goes to its
nearest entry (ties to the lower index), np.add.at gathers integer sums and counts per part and entry, and these
tensors, whose size does not depend on the rows, are merged in a reduction tree. The driver sees one pair of tensors a
round. A last pass over the blocks gives codes and errors.

Scale: blocks are written to the shared folder once, so rounds reread them and a lost executor costs its tasks. What goes
to the tasks with each round are the codebooks (64 entries of a vector's length). Errors are summed by label with counts
combined before the shuffle, saved, and joined to the rows by label, which adaptive execution can split.

Integers are exact at every size: where components or distances might pass 64 bits, a block is computed in Python's
integers, and an error beyond a long is given as the greatest long.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; a vector's length is that
of most kept rows (ties: the longest), and rows of another length, or all rows if it is not a positive multiple of the
number of parts, stay with null code and error; with fewer kept rows than entries a codebook has as many entries as rows;
first entries are those of the least ids (ties: least components; null ids last); repeated rows and equal vectors get
equal codes; null labels are a label of their own, whose error is null only if no row of it has a code; other columns are
not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import save

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block.
BLOCK = 4096
#: Components up to this size have squared distances over a part that 64 bits hold, for parts of up to 2**13 dimensions.
SMALL = 1 << 23
GREATEST = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as int64, or as Python's integers if any is large. Multiplying by 256 is exact but where it overflows."""
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for place, value in np.ndenumerate(x):
        top, bottom = float(value).as_integer_ratio()
        out[place] = top * SCALE // bottom
    return out


def blocks(dimension: int):
    """Batches of (id, label, vector) to rows of blocks: ids, labels, number of vectors, components column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
                data = np.ascontiguousarray(rows.T, dtype=np.float64).tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows], pa.int32()), pa.array([data], pa.binary())], ["ids", "labels", "n", "data"])

    return run


def columns_of(data: bytes, n: int) -> np.ndarray:
    """The components of a block as integers: a row per dimension, a column per vector."""
    return integers(np.frombuffer(data, dtype=np.float64).reshape(-1, n))


def assigned(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part of a block's vectors, and the squared distance to it: arrays (part, vector).

    block: (dimension, vectors); books: (part, entry, dimension within the part)."""
    parts, entries, width = books.shape
    kind = np.int64 if block.dtype == books.dtype == np.int64 else object
    codes, errors = np.empty((parts, block.shape[1]), dtype=np.int64), np.empty((parts, block.shape[1]), dtype=kind)
    every = np.arange(block.shape[1])
    for p in range(parts):
        distance = np.zeros((entries, block.shape[1]), dtype=kind)
        for d in range(width):
            step = block[p * width + d][None, :] - books[p, :, d][:, None]
            distance += step * step
        codes[p] = distance.argmin(axis=0)
        errors[p] = distance[codes[p], every]
    return codes, errors


def gathered(books: np.ndarray):
    """The step of treeAggregate: a block's parts are added to the sums and counts of their nearest entries."""

    def step(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        block = columns_of(bytes(row.data), row.n)
        if block.dtype == object and sums.dtype != object:
            sums = sums.astype(object)
        codes, _ = assigned(block, books)
        width = books.shape[2]
        for p in range(len(books)):
            for d in range(width):
                np.add.at(sums, (p, codes[p], d), block[p * width + d])
            np.add.at(counts, (p, codes[p]), 1)
        return sums, counts

    return step


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def trained(table: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after so many rounds of assigning all vectors and averaging."""
    rows = table.select("n", "data").rdd
    for _ in range(rounds):
        zero = (np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64))
        sums, counts = rows.treeAggregate(zero, gathered(books), merged, depth=3)
        used = counts > 0
        means = sums // np.maximum(counts, 1)[:, :, None]
        books = np.where(used[:, :, None], means, books)
        if books.dtype == object and max(map(abs, books.flat), default=0) < SMALL:
            books = books.astype(np.int64)
    return books


def coded(books: np.ndarray):
    """Blocks to rows (id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, errors = assigned(columns_of(batch.column("data")[k].as_py(), batch.column("n")[k].as_py()), books)
                text = np.ascontiguousarray(codes.T, dtype=np.uint8).tobytes().hex()
                each = 2 * len(books)
                code = [text[i : i + each] for i in range(0, len(text), each)]
                error = [min(e, GREATEST) for e in errors.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def books_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and position, with commas between them."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: id, code (two hex digits a part), error (squared distances to the entries, summed over parts),
    label_error (errors summed over equal labels) and codebooks_sha256."""
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & sound)
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dimension = lengths[0]["size"] if lengths else 0
    fits = F.size("vector") == dimension
    if not dimension or dimension % parts:
        fits, dimension = F.lit(False), parts
    # As many rows as entries: the least ids.
    first = rows.filter(fits).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = integers(np.array([r.vector for r in first], dtype=np.float64).reshape(len(first), dimension))
    books = start.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2)
    if not first:
        return _with_labels(rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), id_col, "")
    table = save(rows.filter(fits).mapInArrow(blocks(dimension), f"ids array<{id_kind}>, labels array<{label_kind}>, n int, data binary"), "blocks")
    books = trained(table, books, rounds)
    done = table.mapInArrow(coded(books), f"id {id_kind}, label {label_kind}, code string, error bigint")
    others = rows.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return _with_labels(save(done.unionByName(others), "codes"), id_col, books_text(books))


def _with_labels(done: DataFrame, id_col: str, text: str) -> DataFrame:
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = save(sums.select("of", F.when(F.col("total") > GREATEST, GREATEST).otherwise(F.col("total")).cast("bigint").alias("label_error")), "labels")
    joined = done.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
