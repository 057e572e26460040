"""Plans that do each row's work once, in many tasks, and send no table through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from credenza.functions import similarity
from credenza.operators import extraction


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_dealt_over_all_partitions_and_read_once_for_labels(spark):
    texts = spark.createDataFrame([(i, "PAN", f"Name: MIRA RO{'ABCDEFGHIJ'[i % 10]}A") for i in range(50)], "doc_id bigint, family string, text string").coalesce(1)
    assert extraction.spread(texts).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan_of(extraction.extract(texts)).count("Generate posexplode(split") == 1


def test_repaired_names_broadcast_no_table(spark, tmp_path):
    texts = spark.createDataFrame([(1, "PAN", "Name: MIRA ROA"), (2, "PAN", "MIRA ROB")], "doc_id bigint, family string, text string")
    fields = spark.createDataFrame([(1, "name", "MIRA ROA", "SAME_LINE", 96.0)], "doc_id bigint, field string, value string, source string, score double")
    references = spark.createDataFrame([(1, "name", "Mira Roaa"), (2, "name", "Mira Roba")], "doc_id bigint, field string, reference string")
    stored = []
    for name, rows in (("fields", fields), ("texts", texts), ("references", references)):  # files whose size is known to be small
        rows.write.parquet(f"{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"{tmp_path}/{name}"))
    found = extraction.repaired(*stored)
    assert "Broadcast" not in plan_of(found)
    assert sorted((r.doc_id, r.value) for r in found.collect()) == [(1, "Mira Roaa"), (2, "Mira Roba")]


def test_ratio_runs_the_plan_of_its_rows_once(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("ab", "ac"), ("a", "abcdefgh"), ("", "a"), (None, None)], "a string, b string")
    out = similarity.with_ratio(rows, F.col("a"), F.col("b"), 0.5)
    assert "Union" not in plan_of(out)
    assert [r.ratio for r in out.collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]
