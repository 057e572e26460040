"""Policy cases of the risk, integrity, profile and identity rules, and properties they must keep."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from credenza.functions import dates, identifiers, similarity, text
from credenza.operators import sequence, store
from credenza.plans import rules

BASE = {
    "n_identity_mismatch": 0, "n_identity_uncertain": 0, "ocr_conf": 90.0, "quality": "GOOD", "n_conflicts": 0, "consistency_band": "LOW", "consistency_score": 0.0, "ref_available": False, "ref_band": "", "ref_score": 0.0,
    "ai_band": "LOW", "ai_score": 0.0, "profile_status": "PASS", "qr_status": "", "n_format_review": 0, "n_fail": 0, "n_missing": 0, "integrity_status": "NO_STRONG_EDIT_SIGNAL", "integrity_score": 0.0, "security_status": "PASS", "security_review_count": 0,
    "fab_verdict": "NO_FABRICATION_SIGNAL", "fab_high": 0, "fab_medium": 0, "verification_overall": "LOW", "cross_status": "PASS", "cross_score": 0.0, "n_indicators": 0, "indicator_severity": "LOW",
}


def risk(spark, **changes):
    row = BASE | changes
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))
    return df.select(*[v.alias(k) for k, v in rules.risk().items()]).first()


def test_weak_signals_are_capped_at_low_confidence(spark):
    out = risk(spark, ocr_conf=42.0, quality="POOR", profile_status="REVIEW", indicator_severity="MEDIUM", n_indicators=1)
    assert out.risk_score <= 24 and out.confidence == "LOW"


def test_identity_is_a_gate_without_points(spark):
    assert risk(spark, n_identity_mismatch=1).risk_score == risk(spark).risk_score
    assert risk(spark, n_identity_mismatch=1).identity_gate == "FAIL" and risk(spark, n_identity_uncertain=1).identity_gate == "REVIEW"


def test_encoded_mismatch_outweighs_low_confidence(spark):
    assert risk(spark, ocr_conf=40.0, quality="POOR", qr_status="MISMATCH").risk_score > 24


def test_mixed_mediums_are_reviewed(spark):
    out = risk(spark, ai_band="MEDIUM", ai_score=25.0, consistency_band="MEDIUM", consistency_score=24.0, profile_status="FAIL", n_fail=1)
    assert out.risk_score == 25 and out.screening_outcome == "REVIEW" and out.raw_points == 25


def test_a_high_module_never_lowers_risk(spark):
    for change in ({"ai_band": "HIGH", "ai_score": 90.0}, {"indicator_severity": "HIGH", "n_indicators": 1}, {"integrity_status": "POSSIBLE_EDITING", "integrity_score": 60.0}):
        assert risk(spark, **change).risk_score >= max(50, risk(spark).risk_score)


def test_integrity_cases(spark):
    clean = {"ela_outlier_ratio": 0.0, "ela_max_z": 1.0, "texture_outlier_ratio": 0.0, "noise_cv": 0.3, "texture_cv": 0.3, "lap_var": 200.0, "n_editing_markers": 0}
    strong = clean | {"ela_outlier_ratio": 0.1, "ela_max_z": 7.0, "texture_outlier_ratio": 0.12, "noise_cv": 0.8}
    df = spark.createDataFrame([tuple(clean.values()), tuple(strong.values())], list(clean))
    got = [r[0] for r in df.select(rules.integrity()["integrity_status"]).collect()]
    assert got == ["NO_STRONG_EDIT_SIGNAL", "POSSIBLE_EDITING"]


def test_profile_cases(spark):
    df = spark.createDataFrame([("PAN", "INCOME TAX PERMANENT ACCOUNT ABCPE1234F", True), ("PAN", "REPUBLIC PASSPORT", True), ("OTHER", "x", True)], "family string, t string, has boolean")
    status, score = rules.profile(F.col("family"), F.col("t"), F.col("has"))
    assert [tuple(r) for r in df.select(status, score).collect()] == [("PASS", 69), ("FAIL", 0), ("UNAVAILABLE", 0)]


def verhoeff_plain(number: str) -> bool:
    check, table = 0, identifiers.permutations()
    for i, digit in enumerate(reversed(number)):
        check = identifiers.dihedral(check, table[i % 8][int(digit)])
    return bool(number) and check == 0


def test_verhoeff(spark):
    numbers = ["582036172943", "582036172944", "123412341234", "", "000000000000", *[str(7919 * i).zfill(12) for i in range(200)]]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = [r[0] for r in df.select(identifiers.verhoeff_valid(F.col("n"))).collect()]
    assert got == [verhoeff_plain(n) for n in numbers] and got[:3] == [True, False, True]
    # One wrong digit is always found.
    assert not any(verhoeff_plain("582036172943"[:i] + d + "582036172943"[i + 1 :]) for i, d in itertools.product(range(12), "0123456789") if d != "582036172943"[i])


@pytest.mark.parametrize(("value", "want"), [("15/08/2005", "2005-08-15"), ("2005-8-15", "2005-08-15"), ("31-02-2005", None), ("x", None), (None, None)])
def test_strict_dates(spark, value, want):
    got = spark.createDataFrame([(value,)], "x string").select(dates.strict(F.col("x"))).first()[0]
    assert (str(got) if got else None) == want


def test_pivots(spark):
    df = spark.createDataFrame([("490101", "01.02.49"), ("500101", "31.04.50")], "m string, n string")
    assert [(str(r[0]), r[1]) for r in df.select(dates.machine_zone(F.col("m")), dates.numeric(F.col("n"))).collect()] == [("2049-01-01", "01/02/49"), ("1950-01-01", None)]


def test_similarity_prefilter_agrees(spark):
    pairs = [("holder name", "holder nam"), ("abc", "abcdefghijkl"), ("", ""), ("same", "same"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = similarity.with_ratio(df.withColumn("r", similarity.ratio("a", "b")), F.col("a"), F.col("b"), 0.7).collect()
    assert len(rows) == len(pairs) and all(r.ratio == r.r or (r.ratio == 0.0 and r.r < 0.7) for r in rows)


def test_upsert_is_idempotent(spark):
    rows = [("N1", 1, "A", "PAN", 1), ("N1", 2, None, "VISA", 2), ("N2", 3, "C", "PAN", 1)]
    df = spark.createDataFrame(rows, "number_key string, owner int, full_name string, id_type string, created_at int")
    once = store.registry_upsert(df, "number_key", ["created_at"]).orderBy("number_key").collect()
    twice = store.registry_upsert(df.union(df), "number_key", ["created_at"]).orderBy("number_key").collect()
    assert once == twice and tuple(once[0])[1:4] == (2, "A", "PAN")


def test_patch_keeps_by_rule(spark):
    table = spark.createDataFrame([(1, "Old", 5), (2, "Two", 6)], "id int, name string, risk int")
    changes = spark.createDataFrame([(1, " ", 7), (2, "New", None)], "id int, name string, risk int")
    assert sorted(tuple(r) for r in store.patch(table, changes, "id", ["name"], ["risk"]).collect()) == [(1, "Old", 7), (2, "New", 6)]


def test_lines_join_by_recent_mean(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 14.0, 10.0), (1, 2, 60.0, 10.0), (1, 3, 12.0, 10.0)], "doc_id bigint, seq bigint, yc double, height double")
    assert [r.line for r in sequence.line_groups(df).orderBy("seq").collect()] == [0, 0, 1, 0]


def test_normalisers_differ(spark):
    row = spark.createDataFrame([(" ab-1 é ",)], "x string").select(text.document_number(F.col("x")), text.match_text(F.col("x"))).first()
    assert tuple(row) == ("AB1É", "ab1")
