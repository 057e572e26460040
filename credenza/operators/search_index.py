"""Search for parts of words over whole tables by a stored index of grams.

A row's text columns are cut into all runs of two and of three characters (lower-cased): rows are dealt by blocks of ids, so that
a block's lists are made in one place and only whole lists are moved. The index has a row per gram and block of
ids: a gram that is in every row is many rows, each bounded by a block. Its files are sorted by gram, so that their
statistics let a reader skip what other grams hold. A query is cut into grams of three (of two if it has only two characters);
their lists are intersected by block, and what is left is looked up in the table and verified on the text.

Defined cases: null and empty columns have no grams; a query's characters stand for themselves; queries of fewer than two characters, once
trimmed, raise; ids are whole numbers and may repeat (every row of such an id is looked up); an empty table has an empty index.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a block: a power of two.
BLOCK_BITS = 16
#: Rows, and postings, that are worked on together, about.
ROWS, POSTINGS = 1 << 16, 1 << 22
#: A code point, plus one, takes this many bits of a gram's number.
POINT = 21


def grams(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct runs of two and of three characters of each value: numbers of the grams and of their values."""
    point = np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
    value = np.repeat(np.arange(len(values)), [len(v) for v in values])
    found = []
    for n in (2, 3):
        at = np.flatnonzero(value[n - 1 :] == value[: len(value) - n + 1])
        found.append((reduce(np.bitwise_or, [point[at + i] << POINT * i for i in range(n)]), value[at]))
    gram, value = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((value, gram))
    gram, value = gram[order], value[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (value[1:] != value[:-1])][: len(gram)]
    return gram[new], value[new]


def gram_text(number: int) -> str:
    return "".join(chr((number >> POINT * i & (1 << POINT) - 1) - 1) for i in range(3) if number >> POINT * i)


def lists(table: pa.Table, block_bits: int):
    """Rows (id, block, folded columns) of whole blocks to their lists (gram, block, ids), each column's grams cut once per distinct value."""
    names, rank = np.unique(table.column("id").to_numpy(), return_inverse=True)
    values, order, counts = [], [], []
    for column in table.columns[2:]:
        own = column.combine_chunks().dictionary_encode()
        codes = own.indices.to_numpy()
        values += own.dictionary.to_pylist()
        order.append(rank[np.argsort(codes, kind="stable")])
        counts.append(np.bincount(codes, minlength=len(own.dictionary)))
    gram, value = grams(values)
    if not len(gram):
        return
    ranks, counts = np.concatenate(order), np.concatenate(counts)
    starts, held = (np.cumsum(counts) - counts)[value], counts[value]
    firsts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    number = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(gram)]))
    # Cut where a gram begins, so that no list is made in two pieces.
    whole = np.cumsum(held)
    cuts = firsts[np.flatnonzero(np.diff((whole - held)[firsts] // POSTINGS, prepend=-1))]
    for a, b in zip(cuts, [*cuts[1:], len(gram)], strict=True):
        n = held[a:b]
        at = np.arange(n.sum()) + np.repeat(starts[a:b] - np.cumsum(n) + n, n)
        key = np.repeat(number[a:b] << 32, n) | ranks[at]
        key.sort()
        key = key[np.flatnonzero(np.diff(key, prepend=-1))]
        own, ids = key >> 32, names[key & 0xFFFFFFFF]
        block = ids >> block_bits
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])])
        texts = {x: gram_text(int(gram[firsts[x]])) for x in np.unique(own).tolist()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([texts[x] for x in own[first].tolist()], pa.string()), pa.array(block[first], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[first, len(ids)], pa.int32()), pa.array(ids, pa.int64()))],
            ["gram", "block", "ids"],
        )


def postings(block_bits: int):
    """Rows (id, block, folded columns), sorted by block, to lists (gram, block, ids)."""

    def run(batches):
        waiting, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            # The last block may go on in the next batch.
            table = pa.Table.from_batches(waiting)
            block = table.column("block").to_numpy()
            ended = int(np.searchsorted(block, block[-1]))
            if ended:
                yield from lists(table.slice(0, ended), block_bits)
            waiting, rows = table.slice(ended).to_batches(), table.num_rows - ended
        if waiting:
            yield from lists(pa.Table.from_batches(waiting), block_bits)

    return run


def folded(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def build(table: DataFrame, path: str, columns: list[str], key: str, block_bits: int = BLOCK_BITS) -> None:
    """Writes the index of the table's columns: gram, block, ids (ascending)."""
    rows = table.select(F.col(key).cast("bigint").alias("id"), *(folded(c).alias(f"c{i}") for i, c in enumerate(columns))).filter("id IS NOT NULL")
    rows = rows.select("id", F.shiftright("id", block_bits).alias("block"), *rows.columns[1:])
    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(postings(block_bits), "gram string, block bigint, ids array<bigint>")
    # Dealt by gram and 64 blocks: ranges would be sampled first, which makes all lists twice.
    found = found.repartition("gram", F.shiftright("block", 6)).sortWithinPartitions("gram", "block")
    found.write.option("parquet.block.size", 1 << 20).option("parquet.bloom.filter.enabled#gram", "true").option("parquet.bloom.filter.expected.ndv#gram", 4096).parquet(path)


def wanted(words: str) -> list[str]:
    """The grams that a query's text must have."""
    words = words.strip().lower()
    if len(words) < 2:
        raise ValueError("a search takes two characters or more")
    n = min(3, len(words))
    return sorted({words[i : i + n] for i in range(len(words) - n + 1)})


def candidates(index: DataFrame, words: str) -> DataFrame:
    """Ids whose rows have all grams of the query, in one column or over several."""
    need = wanted(words)
    lists = index.filter(F.col("gram").isin(*need)).groupBy("block").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(need))
    both = F.reduce(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select(F.explode(both).alias("id"))


def search(index: DataFrame, table: DataFrame, words: str, columns: list[str], key: str, most: int = 30) -> DataFrame:
    """The newest `most` rows that have the words in one of the columns, in any case."""
    left = candidates(index, words).withColumnRenamed("id", "__id")
    found = table.join(left, F.col(key).cast("bigint") == F.col("__id"), "left_semi")
    hit = reduce(Column.__or__, [F.contains(folded(c), F.lit(words.strip().lower())) for c in columns])
    return found.filter(hit).orderBy(F.desc(key)).limit(most)
