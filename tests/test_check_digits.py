"""The check digit's work per number."""

from __future__ import annotations

from pyspark.sql import functions as F

from credenza.functions import identifiers


def test_digits_of_a_number_are_taken_out_once(spark):
    assert identifiers.verhoeff_valid(F.col("n"))._jc.toString().count("regexp_replace") == 1
    rows = spark.createDataFrame([("2363",), ("2364",), ("23 63",), ("",), (None,), ("x",)], "n string").select(identifiers.verhoeff_valid(F.col("n")).alias("v"))
    assert [r.v for r in rows.collect()] == [True, False, True, False, False, False]
