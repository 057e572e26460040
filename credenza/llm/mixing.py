"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue. Its documents are put in a reproducible random order (md5 of id and seed) and
repeated up to `most_repeats` times; a copy's virtual finish time is the source's cumulative tokens up to
and with it, divided by the source's target weight in tokens. Copies are sorted by finish time over all
sources and served until the next one would exceed the total budget (the sum of all sizes).

Targets: the budget times weight over the sum of weights; a target above `most_repeats` times its
source's size is cut to that and the excess is shared again by weight until none is above.

Scale: no source and no global order is ever one task. Cumulative sums run over hash slices of each
source's order (sums per slice first, then inside a slice). The global range sort is a radix search: finish
times are integers of 2**-40, tokens are summed per leading digits, the digit where the budget runs
out is refined twice, and only the copies that share all of those digits are ordered one by one.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own,
last in order; very long texts count whole; repeated rows are separate documents; equal order keys are broken by id and size; an
empty table gives an empty result. mix_sources() carries no other columns, mixed_rows() carries all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credenza.llm.common import WORD, save

SLICES = 1024
#: Finish times are counted in 2**-TICKS of a full target; the radix search drops DIGITS bits at a time.
TICKS, DIGITS = 40, (32, 20)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, seed: int, slices: int, id_col: str, text_col: str, source_col: str, *extra: Column) -> DataFrame:
    """__id, __source, __size, __key (the random order) and __slice (its leading part) of every row."""
    rows = docs.select(*extra, F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), word_count(F.col(text_col)).alias("__size"))
    rows = rows.withColumn("__key", F.md5(F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))
    return rows.withColumn("__slice", F.floor(F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * slices / (1 << 24)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds total and target.

    The water level in closed form: ordered by cap / weight, capped sources are a prefix, and the first
    source that is not capped sets the level of all that follow.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most_repeats)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("rest", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(every))
    )
    return ranked.select("source", "source_size", "total", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def slice_starts(rows: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """Per source and slice: tokens of the source's earlier slices, source_size, total and target."""
    by_slice = rows.groupBy(F.col("__source").alias("source"), F.col("__slice").alias("slice")).agg(F.sum("__size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    goal = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most_repeats).withColumnRenamed("source", "g_source")
    return by_slice.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select("source", "slice", "before", "source_size", "total", "target")


def placed(rows: DataFrame, starts: DataFrame, most_repeats: int) -> DataFrame:
    """Adds `ticks`: the virtual finish time of each of the row's copies, as integers."""
    inside = Window.partitionBy("__source", "__slice").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__local", F.sum("__size").over(inside))
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__slice") == F.col("slice")))
    upto = F.col("before") + F.col("__local")
    tick = [F.floor((upto + F.col("source_size") * e) / F.col("target") * (2.0**TICKS)).cast("long") for e in range(most_repeats)]
    return rows.withColumn("ticks", F.when((F.col("__size") > 0) & (F.col("target") > 0), F.array(*tick)).otherwise(F.array().cast("array<bigint>"))).drop("source", "slice", "before", "__local")


def last_served(queued: DataFrame) -> tuple[int, str] | None:
    """(ticks, key) of the last copy served before the budget is spent; None if all are served."""
    left = queued.agg(F.max("total")).first()[0]
    copies = queued.select("__key", "__id", "__size", F.explode("ticks").alias("tick"))
    for bits in DIGITS:
        digit = F.shiftright("tick", bits)
        running = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = copies.groupBy(digit.alias("digit")).agg(F.sum("__size").alias("tokens")).withColumn("upto", F.sum("tokens").over(running))
        over = sums.filter(F.col("upto") > F.lit(left)).orderBy("digit").select("digit", (F.col("upto") - F.col("tokens")).alias("before")).first()
        if over is None:
            return None
        left -= over["before"]
        copies = copies.filter(digit == F.lit(over["digit"]))
        first = over["digit"] << bits
    running = Window.orderBy("tick", "__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    fits = copies.withColumn("upto", F.sum("__size").over(running)).filter(F.col("upto") <= F.lit(left))
    last = fits.orderBy(F.desc("tick"), F.desc("__key")).select("tick", "__key").first()
    return (last["tick"], last["__key"]) if last else (first - 1, "")


def copies_served(last: tuple[int, str] | None) -> Column:
    if last is None:
        return F.size("ticks")
    tick, key = last
    return F.size(F.filter("ticks", lambda t: (t < F.lit(tick)) | ((t == F.lit(tick)) & (F.col("__key") <= F.lit(key)))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, seed: int = 17, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, source, size, source_size, target of its source, copies, taken (size times copies)."""
    rows = save(keyed(docs, seed, slices, id_col, text_col, source_col), "mix")
    queued = placed(rows, slice_starts(rows, weights, most_repeats), most_repeats)
    copies = copies_served(last_served(queued)).cast("int")
    return queued.select(
        F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__size").alias("size"), "source_size", "target",
        copies.alias("copies"), (F.col("__size") * copies).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, seed: int = 17, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every column of docs, each row as often as it is served."""
    narrow = save(keyed(docs, seed, slices, id_col, text_col, source_col), "mix")
    starts = slice_starts(narrow, weights, most_repeats)
    last = last_served(placed(narrow, starts, most_repeats))
    whole = placed(keyed(docs, seed, slices, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")), starts, most_repeats)
    served = whole.withColumn("__copies", copies_served(last)).filter("__copies > 0")
    return served.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select("__row.*")
