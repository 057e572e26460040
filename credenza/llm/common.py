"""Helpers shared by the training-data operators: shared storage, Arrow batches, words and hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points that are not one of these six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a default where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def save(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/credenza-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a table made by save() that no later plan reads."""
    spark = df.sparkSession
    for root in {f.rsplit("/credenza-", 1)[0] + "/credenza-" + f.rsplit("/credenza-", 1)[1].split("/")[0] for f in df.inputFiles() if "/credenza-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs whose tables have been saved (it does so when the
    driver's JVM collects garbage, which an idle driver may not do for half an hour)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to batches (or dicts of columns in the schema's order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose text column holds about `most` bytes each; never splits a row."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


class Memo(dict):
    """Results of a pure function, by argument. Emptied when what it holds passes `most` bytes, about."""

    #: Bytes of an entry beside its key's and value's own.
    ENTRY = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key, value, size: int):
        """Keeps a result whose key and value take `size` bytes, and returns it."""
        if self.held + size + self.ENTRY > self.most:
            self.clear()
            self.held = 0
        if size < self.most >> 6:
            self[key] = value
            self.held += size + self.ENTRY
        return value


class WordIds(Memo):
    """Word (bytes) to its 64-bit xxh3 hash, so that a word is hashed once as a rule."""

    def __init__(self, seed: int = 0, most: int = 48 << 20):
        super().__init__(most)
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        return self.keep(word, xxhash.xxh3_64_intdigest(word, self.seed), len(word))

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


#: Words of up to this many bytes are hashed by table; the few longer ones by xxh3.
TABLED = 64
_table = mix(np.arange(1, TABLED * 256 + 1, dtype=np.uint64) * np.uint64(_BASE))
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, one text's after the other's, and how many each text has.

    A word's hash is the exclusive or of a table's entries for each of its bytes and places (tabulation hashing), made for
    about `most` bytes at a time, so no word becomes a Python object."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    inside = ~_blank[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([1, *(len(text) + 1 for text in texts)])
    counts = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts
    taken = np.minimum(lengths, TABLED)
    ends = np.cumsum(taken)
    found = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1] + most, most), side="left").clip(max=len(starts) - 1) + 1)
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        own = taken[a:b]
        first = ends[a:b] - own - (ends[a] - taken[a])
        n = np.arange(int(first[-1] + own[-1]))
        place = n - np.repeat(first, own)
        byte = raw[n + np.repeat(starts[a:b] - first, own)]
        found[a:b] = np.bitwise_xor.reduceat(_table[(place << 8) | byte], first)
    long = np.flatnonzero(lengths > TABLED)
    if len(long):
        import xxhash

        for i in long.tolist():
            found[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
    return found, counts


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive ids (len - k + 1 of them; none if fewer than k): a polynomial of
    the ids modulo 2**64 from prefix sums, so the cost does not depend on k."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(ids))
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(ids * up, out=sums[1:])
    return mix(((sums[k:] - sums[:-k]) * down[:n]) ^ np.uint64(k * _BASE & 0xFFFFFFFFFFFFFFFF))
