"""URL filters: allow and block rules on host and path prefixes, by a sort-merge range join.

A url's host becomes its labels in reverse, each followed by a dot ("www.example.net" -> "net.example.www."),
so a rule on a host and its subdomains is the key interval [k, k with its last dot raised by one). Urls
(distinct ones, so that a repeated url is judged once) and rule starts are put in key order; a sweep over
each partition keeps a stack of the rules whose interval holds the current key (they are nested) and
gives each url the longest of those whose path is a prefix of its own.

Scale: the key space is cut at quantiles of a bounded sample of keys (`splits` cuts, at most
`sample_rows` keys), which affects balance only; a hot host is cut by path. A rule is sent to every
partition its interval touches, so each partition starts with an empty stack and needs no other. The
verdicts are joined to the rows by url (a sort-merge join that adaptive execution can split at hot urls).

Longest: by host length plus path length, then by host length, then by the rule's text.

Defined cases: a null url or one without "://" has an empty host and path and fits no rule; such urls and
those that no rule fits get the default verdict; very long urls are read whole; repeated rows give repeated results; an empty table or an
empty rule table gives an empty result or default verdicts. Columns other than id and url are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more key ranges, sorted by range, key and kind (rules first)."""
    part, stack = None, []
    for batch in batches:
        columns = batch.to_pydict()
        out_url, out_rule, out_verdict = [], [], []
        for p, key, is_url, url, path, rule_path, verdict, host in zip(*(columns[c] for c in ("part", "key", "is_url", "url", "path", "rule_path", "verdict", "rule_host")), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule_path, verdict, host))
                continue
            best = max((s for s in stack if path.startswith(s[1])), key=lambda s: (len(s[3]) + len(s[1]), len(s[3]), s[3] + s[1], s[2]), default=None)
            out_url.append(url)
            out_rule.append(best[3] + best[1] if best else None)
            out_verdict.append(best[2] if best else None)
        yield pa.RecordBatch.from_arrays([pa.array(out_url, pa.string()), pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())], ["j_url", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", splits: int | None = None, sample_rows: int = 100_000) -> DataFrame:
    """Per row: id, host, path, rule (host and path of the winning rule, or null) and verdict."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    urls = rows.filter("host != ''").groupBy("url", "host", "path").agg(F.lit(1).alias("one")).drop("one")
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.col("path")))
    # Only balance depends on the cuts: a bounded sample of keys is enough, whichever rows are in it.
    splits = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fraction = 1.0
    n = rows.count()
    if n > sample_rows // 2:
        fraction = sample_rows / 2 / n
    sampled = sorted(r[0] for r in rows.filter("host != ''").sample(fraction, seed=7).select(F.concat(reversed_host(F.col("host")), F.col("path"))).limit(sample_rows).collect())
    cuts = sorted({sampled[i * len(sampled) // splits] for i in range(1, splits)}) if sampled else []
    cut_array = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")

    def place(key: Column) -> Column:
        """Number of cuts at or below key, by binary search."""
        whole = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

        def halved(range_: Column, _: Column) -> Column:
            low, high = range_["low"], range_["high"]
            middle = F.floor((low + high) / 2).cast("int")
            after = (low < high) & F.coalesce(F.get(cut_array, middle) <= key, F.lit(False))
            return F.struct(F.when(after, middle + 1).otherwise(low).alias("low"), F.when(after, high).otherwise(F.least(high, middle)).alias("high"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), whole, halved, lambda r: r["low"])

    start = reversed_host(F.col("rule_host"))
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    spread = rules.withColumn("key", start).withColumn("part", F.explode(F.sequence(place(F.col("key")), place(end))))
    events = (
        urls.withColumn("part", place(F.col("key"))).select("part", "key", F.lit(True).alias("is_url"), "url", "path", F.lit(None).cast("string").alias("rule_path"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule_host"))
        .unionByName(spread.select("part", "key", F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("path"), "rule_path", "verdict", "rule_host"))
    )
    # Keys of a part in order; a rule's key is a prefix of the keys it holds, so it sorts before them.
    ordered = events.repartition(F.col("part")).sortWithinPartitions("part", "key", "is_url")
    judged = ordered.mapInArrow(sweep, "j_url string, rule string, verdict string")
    joined = rows.join(judged, F.col("url") == F.col("j_url"), "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
