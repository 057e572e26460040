"""VARIANT bodies: paths, alternates, entries and storage by path."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from credenza.functions import variants


def test_paths_and_alternates(spark, tmp_path):
    bodies = ['{"a": {"b": [{"c": " "}, {"c": "x"}]}, "d": 5}', '{"d": "y"}', "{bad", None, "", "[1]", '"s"', '{"a": null, "d": {"e": 1}}', '{"a": {"b": "q"}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", variants.parsed(F.col("body")).alias("body"))
    kept = variants.store(rows, f"{tmp_path}/v")
    got = {r.id: (r.s, r.n) for r in kept.select("id", variants.first_of(F.col("body"), ("$.a.b[0].c", "$.a.b[1].c", "$.d")).alias("s"), variants.at(F.col("body"), "$.d", "int").alias("n")).collect()}
    assert got[0] == ("x", 5) and got[1] == ("y", None) and all(got[i] == (None, None) for i in (2, 3, 4, 5, 6, 8)) and got[7][1] is None
    assert kept.filter("body IS NULL").count() == 3


def test_stored_paths_are_read_alone(spark, tmp_path):
    rows = spark.range(100).select(variants.parsed(F.format_string('{"a": %d, "b": "x%d"}', "id", "id")).alias("body"))
    kept = variants.store(rows, f"{tmp_path}/v")
    picked = kept.select(variants.at(F.col("body"), "$.a", "bigint").alias("a"))
    assert picked.agg(F.sum("a")).first()[0] == 4950 and "ReadSchema: struct<body:struct<0:bigint>>" in picked._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.variant.writeShredding.enabled") in ("true", "false")


def test_entries(spark):
    details = ['{"a": 1, "b": {"c": [1, null]}}', "{}", None, "", "text", "[1]", '{"user": 3, "z": "é\\"}"}', ' {"a": "}"} ']
    df = spark.createDataFrame(list(enumerate(details)), "id int, d string").withColumn("u", F.lit('{"n": "v"}'))
    got = {r.id: r.d for r in df.select("id", variants.with_entry(F.col("d"), "user", F.col("u")).alias("d")).collect()}
    for i, text in enumerate(details):
        try:
            own = json.loads(text or "")
        except ValueError:
            own = {}
        own = own if isinstance(own, dict) else {}
        own.pop("user", None)
        assert json.loads(got[i]) == own | {"user": {"n": "v"}}
