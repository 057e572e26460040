"""History, windows and votes as functions of DataFrames: the caller names the columns and gives the limits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credenza.functions import text

SEVERITIES = ("LOW", "MEDIUM", "HIGH")


def search(table: DataFrame, words: str, columns: list[str], order: str, most: int = 30) -> DataFrame:
    """Rows that have the words in one of the columns, in any case; the newest `most`."""
    hit = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.strip().lower())) for c in columns])
    return table.filter(hit).orderBy(F.desc(order)).limit(most)


def lookup(table: DataFrame, key: str, values: list, guard: Column | None = None) -> DataFrame:
    found = table.filter(F.col(key).isin(*values))
    return found.filter(guard) if guard is not None else found


def trailing_failures(attempts: DataFrame, user: str, at: str, failed: Column, minutes: int, name: str = "failures") -> DataFrame:
    """Adds to each attempt the number of failures of its user in the minutes up to and with it."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    trailing = Window.partitionBy(user).orderBy(seconds).rangeBetween(-minutes * 60_000_000, 0)
    return attempts.withColumn(name, F.count_if(failed).over(trailing))


def lockouts(attempts: DataFrame, user: str, at: str, order: str, success: str, most: int = 5, minutes: int = 15) -> DataFrame:
    """attempts: user, at, order, success. Adds throttled: at least `most` failures of the user in the minutes before the attempt,
    where a throttled attempt is itself a failure and so extends the lockout. One pass over each user's attempts in
    order; the state is its last `most` failures, however many attempts it has."""
    from credenza.streaming.auth import throttled_rows

    rows = attempts.select(F.col(user).alias("user"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(order).alias("order"), F.col(success).alias("success"), F.struct(*attempts.columns).alias("row"))
    ordered = rows.repartition("user").sortWithinPartitions("user", "micros", "order")
    span = minutes * 60_000_000

    def run(batches):
        now, failures = None, []
        for batch in batches:
            users, times, right = (batch.column(c).to_pylist() for c in ("user", "micros", "success"))
            flags = []
            for name, micros, ok in zip(users, times, right, strict=True):
                if name != now:
                    now, failures = name, []
                flags += throttled_rows([(micros, ok)], failures, most, span)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(flags, pa.bool_())], ["row", "throttled"])

    return ordered.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, throttled boolean").select("row.*", "throttled")


def latest_unused(codes: DataFrame, keys: list[str], order: str, used_at: str = "used_at") -> DataFrame:
    """Per key the newest code that is not used."""
    columns = [c for c in codes.columns if c not in keys]
    newest = codes.filter(F.col(used_at).isNull()).groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__new"))
    return newest.select(*keys, "__new.*")


def newest_each(table: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Per key its first `most` rows."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def duplicate_decisions(docs: DataFrame, number: str, owner: str, order: str, counter: str, most: int = 2) -> DataFrame:
    """Adds decision: NEW for a number's first row, CONFLICT_OTHER_OWNER, REVERIFY, or REVERIFY_LIMIT at `most`."""
    first = docs.groupBy(F.col(number).alias("__number")).agg(F.min(order).alias("__first"), F.min_by(owner, order).alias("__owner"))
    decision = F.when(F.col("__first").isNull() | (F.col("__first") == F.col(order)), "NEW").when(F.col("__owner") != F.col(owner), "CONFLICT_OTHER_OWNER").when(F.coalesce(F.col(counter), F.lit(0)) >= most, "REVERIFY_LIMIT").otherwise("REVERIFY")
    return docs.join(first, F.col(number) == F.col("__number"), "left").withColumn("decision", decision).drop("__number", "__first", "__owner")


def distinct_best(rows: DataFrame, keys: list[Column], score: str, order: str) -> DataFrame:
    """Of rows equal in the keys the one of the highest score, the first on ties."""
    first = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def overlaps(boxes: DataFrame, page: str = "doc_id", box: str = "box_id") -> DataFrame:
    """Pairs of a page's boxes that overlap, and their intersection over union."""
    a, b = (boxes.select(page, *[F.col(c).alias(f"{c}{i}") for c in (box, "x", "y", "w", "h")]) for i in (1, 2))
    inter = F.greatest(F.lit(0), F.least(F.col("x1") + F.col("w1"), F.col("x2") + F.col("w2")) - F.greatest("x1", "x2")) * F.greatest(F.lit(0), F.least(F.col("y1") + F.col("h1"), F.col("y2") + F.col("h2")) - F.greatest("y1", "y2"))
    pairs = a.join(b, page).filter(F.col(f"{box}1") < F.col(f"{box}2")).withColumn("inter", inter).filter("inter > 0")
    return pairs.select(page, F.col(f"{box}1").alias("first_box"), F.col(f"{box}2").alias("second_box"), (F.col("inter") / F.greatest(F.lit(1), F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2") - F.col("inter")).cast("double")).alias("iou"))


def vote(rows: DataFrame, group: str, value: str, conf: str, order: str, quorum: int = 2) -> DataFrame:
    """Per group the value most rows have (then of the highest confidence, then the first), and whether enough have it."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.max(conf).alias("best_conf"), F.min(order).alias("__first"))
    best = counts.groupBy(group).agg(F.max_by(F.struct(value, "n", "best_conf"), F.struct("n", "best_conf", -F.col("__first"), -F.col(value))).alias("__best"))
    return best.select(group, "__best.*").withColumn("quorum", F.col("n") >= quorum)


def worst_severity(signals: DataFrame, group: str, severity: str, status: str) -> DataFrame:
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity))
    sums = signals.groupBy(group).agg(F.max(level).alias("__worst"), F.count_if(F.col(status) == "FAIL").alias("n_fail"), F.count_if((F.col(severity) == "HIGH") & (F.col(status) == "FAIL")).alias("n_high_fail"))
    return sums.select(group, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("__worst").cast("int")).alias("severity"), "n_fail", "n_high_fail")


def moving_mean(rows: DataFrame, user: str, order: list[str], value: str, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(user).orderBy(*order).rowsBetween(1 - n, 0)))


def peaks(rows: DataFrame, key: str, value: str, share: float = 0.95, scale: float = 3 * 1.4826) -> DataFrame:
    """Per key its greatest value if one is further from the median than `scale` median deviations, else the quantile at
    `share`; whole numbers, cut down. Order statistics by rank, interpolated in the arithmetic of SQL's engine (one rounding of
    low * (1 - part) plus the rounded high * part), as the last bit decides about the cut."""
    group = Window.partitionBy(key)
    order = lambda c: group.orderBy(F.asc_nulls_last(c))
    place = lambda q: (F.col("__n") - 1) * F.lit(q)
    at = lambda c, rank, where: F.max(F.when(F.col(rank) - 1 == where, F.col(c)))
    # Halves: the products are exact, so plain arithmetic rounds once.
    part = lambda q: place(q) - F.floor(place(q))
    ranked = rows.select(key, F.col(value).alias("__v")).withColumns({"__n": F.count("__v").over(group), "__i": F.row_number().over(order("__v"))})
    middle = at("__v", "__i", F.floor(place(0.5))).over(group) * (1 - part(0.5)) + at("__v", "__i", F.ceil(place(0.5))).over(group) * part(0.5)
    away = ranked.withColumn("__d", F.abs(F.col("__v") - middle)).withColumn("__j", F.row_number().over(order("__d")))
    sums = away.groupBy(key).agg(
        F.max("__v").alias("top"), F.max("__d").alias("far"), F.max(part(0.5)).alias("half"), F.max(part(share)).alias("part"),
        at("__d", "__j", F.floor(place(0.5))).alias("d0"), at("__d", "__j", F.ceil(place(0.5))).alias("d1"), at("__v", "__i", F.floor(place(share))).alias("v0"), at("__v", "__i", F.ceil(place(share))).alias("v1"),
    )

    @F.pandas_udf("double")
    def between(low: pd.Series, high: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([math.fma(a, 1 - d, b * d) for a, b, d in zip(low, high, part, strict=True)], dtype="float64")

    deviation = F.col("d0") * (1 - F.col("half")) + F.col("d1") * F.col("half")
    peak = F.when(F.col("far") > F.lit(scale) * deviation, F.col("top")).otherwise(between("v0", "v1", "part"))
    return sums.select(key, F.floor(peak).cast("bigint").alias("peak"))


#: Rows of a block of vectors and of a chunk of queries at most, about; a block of fewer where there would be less work than tasks.
BLOCK, LEAST_BLOCK = 16_384, 1_024
#: Queries and vectors whose products are summed at a time.
TILE = 128, 1_024


def _components(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and whether there is one, of lists padded to a width."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat, inside = lists.flatten(), np.arange(width) < sizes[:, None]
    values, there = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    there[inside] = flat.is_valid().to_numpy(zero_copy_only=False)
    values[inside] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    values[~there] = 0.0
    return values, there


def _two_best(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rows: id, value, asked. Query, other, inner product and whether there is one, of the best two of the rows that aren't asked,
    for each that is. Products are summed in the order of the components, as SQL does."""
    asked = rows["asked"].to_numpy()
    ids = rows["id"].to_numpy()
    lists = rows["value"].combine_chunks()
    width = pc.max(pc.list_value_length(lists)).as_py() or 0
    values, there = _components(lists, width)
    plain = there.all(axis=1) & np.isfinite(values).all(axis=1)
    order = np.argsort(ids, kind="stable")
    of = lambda which: order[which[order]]
    queries, others = of(asked & plain), of(~asked & plain)
    # By component, so that a tile's are side by side.
    across, down = np.ascontiguousarray(values[queries].T), np.ascontiguousarray(values[others].T)
    for a in range(0, len(queries), TILE[0]):
        mine = ids[queries[a : a + TILE[0]]]
        for b in range(0, len(others), TILE[1]):
            theirs = ids[others[b : b + TILE[1]]]
            sums = np.zeros((len(mine), len(theirs)))
            part = np.empty_like(sums)
            for k in range(width):
                np.multiply(across[k, a : a + TILE[0], None], down[k, b : b + TILE[1]], out=part)
                sums += part
            sums[mine[:, None] == theirs] = -np.inf
            for _ in range(2):  # of equal ones the first, whose id is the least
                best = sums.argmax(axis=1)
                found = sums[np.arange(len(mine)), best]
                ok = found > -np.inf
                yield mine[ok], theirs[best[ok]], found[ok], np.ones(int(ok.sum()), bool)
                sums[np.arange(len(mine)), best] = -np.inf
    # Vectors that lack components, or have ones that aren't finite: products of what both have, none at all last, not a number first.
    odd = of(~asked & ~plain)
    for q in of(asked):
        those = odd if plain[q] else of(~asked)
        those = those[ids[those] != ids[q]]
        sums, some = np.zeros(len(those)), (there[those] & there[q]).any(axis=1)
        for k in np.flatnonzero(there[q]):
            with np.errstate(invalid="ignore"):
                sums += np.where(there[those, k], values[those, k] * values[q, k], 0.0)
        best = np.lexsort((ids[those], -sums, ~np.isnan(sums), ~some))[:2]
        yield np.full(len(best), ids[q]), ids[those[best]], sums[best], some[best]


def nearest_pair(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", value: str = "embedding", ratio: float = 1.02, blocks: int | None = None) -> DataFrame:
    """For each query vector the nearest of all others by inner product, kept if it is clearly nearer than the second.
    Vectors are dealt to blocks and queries to chunks; each block meets each chunk in one group, which keeps its two best."""
    n, asked = vectors.count(), queries.count()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or max(1, -(-n // BLOCK), min(partitions, n // LEAST_BLOCK))
    chunks = max(1, -(-asked // BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def side(rows: DataFrame, is_query: bool, block: Column, chunk: Column) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(value).alias("value"), F.lit(is_query).alias("asked"), block.alias("block"), chunk.alias("chunk"))

    def best_of(rows: pa.Table) -> pa.Table:
        found = [np.concatenate(c) for c in zip(*_two_best(rows), strict=True)] or [np.empty(0)] * 4
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64(), mask=found[3] == 0, from_pandas=False)], ["q", "other", "c"])

    met = side(vectors, False, dealt(blocks), every(chunks)).unionByName(side(queries, True, every(blocks), dealt(chunks)))
    scored = met.groupBy("block", "chunk").applyInArrow(best_of, "q bigint, other bigint, c double")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "other"))).filter("n <= 2")
    out = best.groupBy("q").agg(F.max(F.when(F.col("n") == 1, F.col("other"))).alias("nearest"), F.max(F.when(F.col("n") == 1, F.col("c"))).alias("c1"), F.max(F.when(F.col("n") == 2, F.col("c"))).alias("c2"))
    return out.select(F.col("q").alias(key), "nearest", (F.col("c1") > F.col("c2") * ratio).alias("kept"))


def public_user(users: DataFrame) -> DataFrame:
    return users.select("unique_id", "full_name", text.email(F.col("email")).alias("email"), "status")
