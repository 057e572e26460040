"""The rules that make evidence, case by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from credenza.plans import evidence

COLUMNS = "doc_id bigint, family string, name string, document_number string, nationality string, course string, valid_until string, ocr_conf double"


def fields(spark, *rows):
    return spark.createDataFrame([(i, family, "TEST PERSON", number, None, None, None, conf) for i, (family, number, conf) in enumerate(rows)], COLUMNS)


def statuses(schema, field):
    return {r.doc_id: r.status for r in schema.filter(F.col("field") == field).collect()}


def test_checksum_needs_a_readable_text_to_fail(spark):
    schema = evidence.schema_checks(fields(spark, ("AADHAAR", "5820 3617 2943", 54.0), ("AADHAAR", "582036172944", 54.0), ("AADHAAR", "582036172944", 90.0)))
    assert statuses(schema, "AADHAAR_CHECKSUM") == {0: "PASS", 1: "REVIEW", 2: "FAIL"}


SCREEN = {"keyword_status": "PASS", "profile_status": "PASS", "qr_status": "NOT_DETECTED", "security_status": "PASS", "integrity_status": "NO_STRONG_EDIT_SIGNAL", "ai_band": "LOW", "n_ai_signals": 0, "consistency_band": "LOW"}


def screened(docs, visual=(), **changed):
    rows = docs.withColumns({c: F.lit(v) for c, v in (SCREEN | changed).items()})
    signals = [F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity")) for t, s in visual]
    return rows.withColumn("visual_signals", F.array(*signals).cast("array<struct<type:string,severity:string>>"))


def test_a_well_formed_number_does_not_make_a_document_genuine(spark):
    docs = screened(fields(spark, ("PAN", "AGTPH9173J", 90.0)), [("PHOTO_REGION_INCONSISTENCY", "HIGH")], security_status="REVIEW", integrity_status="POSSIBLE_EDITING")
    found = evidence.fabrication_signals(docs, evidence.schema_checks(docs))
    assert {r.signal for r in found.collect()} == {"SECURITY_FEATURE_REVIEW", "LOCAL_EDITING_EVIDENCE", "PHOTO_REGION_INCONSISTENCY"}
    verdict = evidence.fabrication_verdicts(docs, found).first()
    assert (verdict.fab_verdict, verdict.fab_status) == ("FABRICATED_OR_TAMPERED", "HIGH")


def test_sample_numbers_of_every_family(spark):
    docs = screened(fields(spark, ("AADHAAR", "123456789012", 90.0), ("PASSPORT", "U1234567", 90.0), ("DRIVING_LICENSE", "DL000000", 90.0), ("COLLEGE_ID", "BE25CS000", 90.0), ("NATIONAL_ID", "AB1234566", 90.0), ("VISA", "000000", 90.0), ("PASSPORT", "U7654329", 90.0)))
    samples = {"PLACEHOLDER_IDENTIFIER", "DOCUMENT_TYPE_SAMPLE_IDENTIFIER", "SEQUENTIAL_OR_REPEATED_IDENTIFIER"}
    got = evidence.fabrication_signals(docs, evidence.schema_checks(docs)).filter(F.col("signal").isin(*samples)).select("doc_id").distinct()
    assert {r.doc_id for r in got.collect()} == {0, 1, 2, 3, 4, 5}


def test_modules_and_absent_documents(spark):
    docs = screened(fields(spark, ("PAN", "AGTPH9173J", 90.0))).withColumns({c: F.lit(v) for c, v in {"schema_status": "PASS", "metadata_status": "REVIEW", "structure_status": " ", "visual_status": "low", "fab_status": "LOW"}.items()})
    modules = evidence.module_statuses(docs)
    assert {r.module: r.status for r in modules.collect()}["structure"] == "UNAVAILABLE"
    row = evidence.verification(modules).first()
    assert (row.overall, row.n_high, row.n_review, row.n_unavailable) == ("LOW", 0, 1, 2)
    none = docs.filter("false")
    assert evidence.schema_checks(none).count() == evidence.verification(evidence.module_statuses(none)).count() == 0


def test_compared_fields(spark):
    rows = [(1, "name", None, "x", "NOT_APPLICABLE"), (1, "name", "  ", "x", "NOT_APPLICABLE"), (1, "name", "Anand", " ", "UNKNOWN"), (1, "name", "Md. Amir", "MD AMIR", "MATCH"), (1, "name", "Anand Kumar", "Anand Kumor", "PARTIAL"), (1, "name", "Anand", "Zoe Pix", "MISMATCH"), (2, "dob", "1990-02-05", "5/2/1990", "MATCH"), (2, "name", "--", "x", "NOT_APPLICABLE")]
    pairs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, field string, reference string, extracted string")
    compared = evidence.compare_fields(pairs)
    assert sorted((r.reference or "", r.extracted, r.status) for r in compared.collect()) == sorted((r[2] or "", r[3], r[4]) for r in rows)
    assert {r.doc_id: r.worst for r in evidence.identity_gates(compared).collect()} == {1: "MISMATCH", 2: "MATCH"}
