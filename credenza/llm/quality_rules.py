"""Quality rules with DataFrame functions only: base rules, then robust multivariate outliers.

Base: a document fails with fewer than `min_words` words, or if more than `max_repeat_pct` percent of its
words lie in 8-word windows that occur twice or more in it.

Method: documents that pass are described by a transformed statistic vector (log mean word length, log
symbol share, square roots of the shares of duplicate lines and repeated words). Per language and source,
and over all documents, a minimum-covariance-determinant estimate is made. A C-step keeps the `share` of the
group's documents that are nearest by Mahalanobis distance (with all that are as near as the last of them, on a
grid of 1/64 of log2(1 + squared distance)) and takes their mean and covariance again, times the usual
consistency factor. C-steps are made from three starts (medians with the MADs; medians with FLOORS alone; mean
and covariance of all) until the determinant no longer falls by a millionth, and the start that ends at
the least determinant gives the estimate. FLOORS are added to each variance, as many groups have constant
coordinates. A document is judged by its group's estimate mixed with that over all documents: both count as
samples, of the group's documents and of `prior` ones, whose joint mean and covariance are taken. So a group of a
few documents is judged much like all, one of thousands by itself, with no size at which the rule changes.
A document is rejected if its squared distance exceeds the chi-square quantile `p_cutoff`.

Scale: the texts are read once; the narrow statistics table is written to the shared folder. Every
estimate is made from sums and integer histograms per group that are combined before the shuffle, so a hot
group is never one task. A C-step is one aggregation over the narrow table, of the groups that still change;
steps pass small tables through the shared folder, not the driver.

Defined cases: null and empty texts have no words and fail; a null language or source is a value of its own;
repeated rows count each; ties in distance stay together; very long texts are read whole; an empty table gives
an empty result; extra columns are not carried by quality() and all carried by kept_rows().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credenza.llm.common import save

SPACE = " \t\n\x0b\x0c\r"
#: Added to each coordinate's variance, squared: the spread that is never held against a document. Each is small
#: enough for the coordinate to pass the cutoff alone: in a group that has neither, over 50.3 % duplicate lines do, or
#: over 24.4 % repeated words (the base rule lets 30 % pass).
FLOORS = (0.15, 0.45, 0.165, 0.115)
#: Histogram cells per unit: of a coordinate, and of log2(1 + squared distance).
GRID, CELLS = 1000, 64


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once per row (a plain reference inside a lambda would be inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, k: int = 8) -> Column:
    """Number of words in k-word windows that occur twice or more. Hashes only screen; strings decide."""

    def exact(w: Column) -> Column:
        hashed = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, k)).alias("h"), i.alias("p"))))
        # Strings are made of windows alone whose hash occurs twice.
        again = bound(hashed, lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])))
        windows = F.array_sort(F.transform(again, lambda x: F.struct(F.array_join(F.slice(w, x["p"], k), " ").alias("k"), x["p"].alias("p"))))

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]))
            places = F.array_sort(F.transform(again, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(k), p + k - acc["end"])).alias("n"), (p + k).alias("end"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return bound(windows, covered)

    def screened(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        distinct = bound(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) < k + 1, 0).when(distinct, 0).otherwise(exact(w))

    return bound(words, screened)


def statistics(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """extra columns, id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    of_words = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(*extra, F.col(id_col).alias("id"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")).select(
        *[c for c in docs.select(*extra).columns] if extra else [], "id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words"
    )


def vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(F.col("n_symbols") * 100.0 / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


D = 4
X, M = [f"x{i}" for i in range(D)], [f"m{i}" for i in range(D)]
#: The group of all documents.
EVERY = "\x1e"
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def median_of(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Per group: the medians of integer grid values, from one histogram per group and coordinate."""
    long = rows.select("gid", F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.round(v * GRID).cast("long").alias("cell")) for i, v in enumerate(values)])).alias("a")).select("gid", "a.*")
    counts = long.groupBy("gid", "axis", "cell").agg(F.count("*").alias("n"))
    group = Window.partitionBy("gid", "axis")
    running = counts.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("all", F.sum("n").over(group))
    middle = running.filter(F.col("upto") * 2 >= F.col("all")).groupBy("gid", "axis").agg((F.min("cell") / GRID).alias("m"))
    return middle.groupBy("gid").agg(*[F.max(F.when(F.col("axis") == i, F.col("m"))).alias(name) for i, name in enumerate(names)])


def factored(estimate: DataFrame, *keys: str) -> DataFrame:
    """keys, m0.., s_ij, the lower factor l_ij of the covariance columns s_ij plus floors, and logdet of that."""
    out = estimate
    for i, j in PAIRS:
        rest = F.col(f"s{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(1, D)), F.log("l00") * 2)
    return out.select(*keys, *M, *[f"{x}{i}{j}" for x in "sl" for i, j in PAIRS], logdet.alias("logdet"))


def squared_distance() -> Column:
    """Of x0.. from m0.. by forward substitution, as one expression of columns."""
    y: list[Column] = []
    for i in range(D):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def moments() -> list[Column]:
    """Aggregates: the number of rows, and sums and products of what x0.. are off m0.. (about which nothing cancels)."""
    off = [F.col(X[i]) - F.col(M[i]) for i in range(D)]
    return [F.count("*").alias("n"), *[F.first(m).alias(m) for m in M], *[F.sum(off[i]).alias(f"a{i}") for i in range(D)], *[F.sum(off[i] * off[j]).alias(f"p{i}{j}") for i, j in PAIRS]]


def from_moments(factor: float) -> list[Column]:
    """Mean and covariance (times factor) of moments()."""
    mean = [(F.col(M[i]) + F.col(f"a{i}") / F.col("n")).alias(M[i]) for i in range(D)]
    return [*mean, *[((F.col(f"p{i}{j}") / F.col("n") - F.col(f"a{i}") / F.col("n") * F.col(f"a{j}") / F.col("n")) * factor).alias(f"s{i}{j}") for i, j in PAIRS]]


def c_step(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """rows: gid, x0..; now: gid, start, m0.., l_ij. The estimates from the nearest rows of each group and start."""
    cell = F.floor(F.log2(squared_distance() + 1) * CELLS).cast("long")
    near = rows.join(now.select("gid", "start", *M, *[f"l{i}{j}" for i, j in PAIRS]), "gid")
    cells = near.groupBy("gid", "start", cell.alias("cell")).agg(*moments())
    group = Window.partitionBy("gid", "start")
    cells = cells.withColumn("nearer", F.sum("n").over(group.orderBy("cell")) - F.col("n")).withColumn("all", F.sum("n").over(group))
    kept = cells.filter(F.col("nearer") < F.col("all") * share)
    sums = [c for c in kept.columns if c[0] in "ap" and c[1:].isdigit()]
    whole = kept.groupBy("gid", "start").agg(F.sum("n").alias("n"), *[F.first(m).alias(m) for m in M], *[F.sum(c).alias(c) for c in sums])
    return factored(whole.select("gid", "start", *from_moments(share / chi2_cdf(chi2_quantile(share, D), D + 2))), "gid", "start")


def estimates(rows: DataFrame, share: float) -> DataFrame:
    """rows: gid, x0..; per group its size n_g and the centre and covariance of its minimum-covariance-determinant estimate."""
    medians = save(median_of(rows, [F.col(x) for x in X], M), "medians")
    mads = median_of(rows.join(medians, "gid"), [F.abs(F.col(X[i]) - F.col(M[i])) for i in range(D)], [f"d{i}" for i in range(D)])
    whole = rows.join(medians, "gid")
    classical = whole.groupBy("gid").agg(*moments())
    first = [
        medians.join(mads, "gid").select("gid", F.lit(0).alias("start"), *M, *[(F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS]),
        medians.select("gid", F.lit(1).alias("start"), *M, *[F.lit(0.0).alias(f"s{i}{j}") for i, j in PAIRS]),
        classical.select("gid", F.lit(2).alias("start"), *from_moments(1.0)),
    ]
    starts = save(factored(first[0].unionByName(first[1]).unionByName(first[2]), "gid", "start"), "mcd")
    best = save(c_step(rows, starts, share).withColumn("open", F.lit(True)), "mcd")
    while best.filter("open").limit(1).count():
        new = c_step(rows, best.filter("open"), share)
        old = best.select(F.col("gid").alias("o_gid"), F.col("start").alias("o_start"), *[F.col(c).alias(f"o_{c}") for c in best.columns[2:]])
        both = old.join(new, (F.col("o_gid") == F.col("gid")) & (F.col("o_start") == F.col("start")), "left")
        lower = F.coalesce(F.col("logdet") < F.col("o_logdet") - 1e-6, F.lit(False))
        best = save(both.select(F.col("o_gid").alias("gid"), F.col("o_start").alias("start"), *[F.when(lower, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in new.columns[2:]], lower.alias("open")), "mcd")
    least = best.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.round("logdet", 6), "start"))).filter("rank = 1")
    return least.join(rows.groupBy("gid").agg(F.count("*").alias("n_g")), "gid").select("gid", "n_g", *M, *[f"s{i}{j}" for i, j in PAIRS])


def mixed(found: DataFrame, prior: int) -> DataFrame:
    """Each group's estimate with that over all documents as `prior` more of its documents, factored."""
    every = found.filter(F.col("gid") == EVERY).select(*[F.col(m).alias(f"e_{m}") for m in M], *[F.col(f"s{i}{j}").alias(f"e_s{i}{j}") for i, j in PAIRS])
    both = found.filter(F.col("gid") != EVERY).join(F.broadcast(every))  # one row
    w = F.col("n_g") / (F.col("n_g") + prior)
    gap = [F.col(m) - F.col(f"e_{m}") for m in M]
    centre = [(w * F.col(m) + (1 - w) * F.col(f"e_{m}")).alias(m) for m in M]
    return factored(both.select("gid", *centre, *[(w * F.col(f"s{i}{j}") + (1 - w) * F.col(f"e_s{i}{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"s{i}{j}") for i, j in PAIRS]), "gid")


def judge(stats: DataFrame, min_words: int, max_repeat_pct: int, prior: int, share: float, p_cutoff: float) -> DataFrame:
    """Adds base_failed, distance (squared; null where base_failed) and kept to a statistics table with lang and source."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    rows = stats.withColumn("base_failed", failed)
    for x, value in zip(X, vector(), strict=True):
        rows = rows.withColumn(x, value)
    rows = rows.withColumn("gid", F.concat_ws("\x1f", F.coalesce(F.col("lang"), F.lit("\x00")), F.coalesce(F.col("source"), F.lit("\x00"))))
    narrow = rows.filter(~F.col("base_failed")).select(F.explode(F.array(F.col("gid"), F.lit(EVERY))).alias("gid"), *X)
    found = save(mixed(estimates(narrow, share), prior).drop("logdet", *[f"s{i}{j}" for i, j in PAIRS]), "mcd")
    judged = rows.join(found.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g"), "left").withColumn("distance", F.when(~F.col("base_failed"), squared_distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_quantile(p_cutoff, D), F.lit(False)))


PARAMETERS = {"min_words": 20, "max_repeat_pct": 30, "prior": 60, "share": 0.75, "p_cutoff": 0.999}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **parameters) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept."""
    stats = save(statistics(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")), "quality")
    judged = judge(stats, **(PARAMETERS | parameters))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of docs that are kept, with all columns. The verdict depends on the row's statistics, language
    and source alone, so the columns go through the statistics table beside them."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    stats = save(statistics(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), row), "quality")
    return judge(stats, **(PARAMETERS | parameters)).filter("kept").select("row.*")
