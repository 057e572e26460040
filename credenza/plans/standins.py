"""Deterministic stand-ins for the store's tables, over the benchmark tables: the same SQL in both engines.

No identity data exists in the test data, so users are customers, stored documents are orders, evidence is
line items, logins are events, OCR text is documents.
"""

from __future__ import annotations

FAMILY = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'PAN' WHEN 1 THEN 'AADHAAR' WHEN 2 THEN 'PASSPORT' WHEN 3 THEN 'DRIVING_LICENSE' WHEN 4 THEN 'COLLEGE_ID' WHEN 5 THEN 'NATIONAL_ID' ELSE 'VISA' END"
TEXT_KEY = "CAST(o_orderkey AS STRING)"
#: Every line item as a box of its document.
BOXES = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS box_id, CAST(l_partkey * 13 % 300 AS BIGINT) AS x, CAST(l_suppkey * 29 % 200 AS BIGINT) AS y,
        CAST(40 + l_partkey % 120 AS BIGINT) AS w, CAST(20 + l_suppkey % 60 AS BIGINT) AS h, l_quantity AS conf, CAST(l_partkey % 10000 AS STRING) AS text FROM lineitem"""

LETTERS = "translate(CAST({} AS STRING), '0123456789', 'ABCDEFGHIJ')"


def cards() -> str:
    """A card's text per customer, in one of three layouts, beside the values that it prints."""
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    values = f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'PAN' WHEN c_custkey % 4 = 1 THEN 'COLLEGE_ID' ELSE 'DRIVING_LICENSE' END AS family,
        'TARUN QA' || {LETTERS.format("c_custkey")} AS holder, 'MOHIT RAVI ZE' || {LETTERS.format("c_nationkey")} AS father,
        CASE WHEN c_custkey % 4 = 0 THEN translate(lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), '0123456789', 'KLMNOPQRST') || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0') || 'X'
          WHEN c_custkey % 4 = 1 THEN 'BE25CS' || lpad(CAST(c_custkey AS STRING), 7, '0') ELSE 'UP342021' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS number,
        {two("1 + c_custkey % 28")} || '/' || {two("1 + c_custkey % 12")} || '/' || CAST(1950 + c_custkey % 50 AS STRING) AS birth,
        'Plot ' || CAST(c_nationkey AS STRING) || ' DIST Mirapur, North Province 48' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS street FROM customer"""
    text = f"""CASE family WHEN 'PAN' THEN 'INCOME TAX DEPARTMENT|Permanent Account Number Card|' || CASE WHEN doc_id % 3 > 0 THEN 'PAN No: ' ELSE '' END || number || '|Name|Valid unless Physically Signed|' || holder || '|Father''s Name|gle u onf|' || father || '|Date of Birth|' || birth
        WHEN 'COLLEGE_ID' THEN 'Student Name: ' || holder || '|Roll No|' || number || '|DOB: ' || birth || ' Sex: ' || CASE WHEN doc_id % 8 = 1 THEN 'F' ELSE 'M' END
        ELSE 'DRIVING LICENCE|DL No: ' || number || '|Name: ' || holder || ' DOB: ' || birth || '|S/O ' || father || '|Address|' || split_part(street, ', ', 1) || '|' || split_part(street, ', ', 2) END"""
    return f"SELECT *, replace({text}, '|', chr(10)) AS text FROM ({values}) c"


STANDINS = {
    "users": """SELECT c_custkey AS unique_id, c_name AS full_name, '  ' || upper(replace(c_name, '#', '.')) || '@Example.ORG ' AS email,
        CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'SUSPENDED' END AS status, CAST(c_custkey * 37 % 101 AS INT) AS latest_risk_score,
        c_custkey % 5 <> 0 AS email_verified, c_mktsegment AS address FROM customer""",
    "docs": f"""SELECT o_orderkey AS id, o_custkey AS owner, {FAMILY} AS id_type,
        ' ' || lower(substr(o_orderpriority, 3, 3)) || '-' || CAST(o_orderkey * 7919 % 4001 AS STRING) || '/' || substr(o_orderpriority, 1, 1) || ' ' AS document_number,
        upper(substr(o_orderpriority, 3, 3)) || CAST(o_orderkey * 7919 % 4001 AS STRING) || substr(o_orderpriority, 1, 1) AS number_key,
        'Holder ' || CAST(o_custkey % 97 AS STRING) AS full_name, o_orderdate AS created_at, o_orderkey * 3 AS verification_id,
        CAST(o_orderkey * 37 % 101 AS INT) AS risk_score, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderkey % 3 AS BIGINT) END AS reverification_count FROM orders""",
    "logins": """SELECT event_id AS id, ts AS event_at, user_id, event_type = 'view' AS success, event_type, value, props FROM events WHERE event_type IN ('view', 'error')""",
    "codes": """SELECT event_id AS id, user_id AS email, CASE WHEN event_id % 2 = 0 THEN 'REGISTER' ELSE 'RESET' END AS purpose, ts AS created_at,
        CASE WHEN event_id % 3 = 0 THEN ts ELSE NULL END AS used_at FROM events WHERE event_type IN ('signup', 'click')""",
    "signals": """SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CASE l_linestatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END AS status, l_quantity * 2 AS conf, l_partkey, l_suppkey, l_extendedprice AS amount FROM lineitem""",
    "evidence": """SELECT l_orderkey AS doc_id, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_high, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n_medium,
        max(l_quantity * 2) AS ocr_conf, sum(CAST(l_quantity AS BIGINT)) AS units FROM lineitem GROUP BY l_orderkey""",
    "boxes": BOXES,
    "features": """SELECT l_orderkey * 8 + l_linenumber AS doc_id, CAST(l_partkey % 1600 + 300 AS INT) AS width, CAST(l_suppkey * 17 % 1100 + 200 AS INT) AS height,
        CAST(l_partkey * 7 % 256 AS DOUBLE) AS brightness, l_quantity AS contrast, CAST(l_partkey * 31 % 900 AS DOUBLE) AS laplacian_variance,
        CAST(l_suppkey % 19 AS DOUBLE) - 9 AS skew_deg, l_discount AS glare_ratio, CAST(l_partkey * 31 % 900 AS DOUBLE) AS lap_var, l_tax AS edge_density,
        l_quantity / 100 AS texture_cv, l_quantity / 50 AS noise_cv, l_discount * 2 AS texture_outlier_ratio, l_tax * 2 AS ela_outlier_ratio,
        CAST(l_suppkey % 12 AS DOUBLE) AS ela_max_z, CAST(l_linenumber % 4 AS INT) AS n_editing_markers, CAST(l_extendedprice AS BIGINT) AS file_size,
        CASE WHEN l_linestatus = 'F' THEN 'editor' END AS software FROM lineitem""",
}


def risk_inputs() -> str:
    """One flat row of evidence per document (see FIXTURES.md, section 4)."""

    def pick(number: int, *values: str | None) -> str:
        cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v)
        return f"CASE CAST(doc_id * {number} % {len(values)} AS INT) {cases} ELSE '' END"

    return f"""SELECT doc_id, CAST(doc_id * 11 % 17 = 0 AS INT) AS n_identity_mismatch, CAST(doc_id * 5 % 4 = 0 AS INT) AS n_identity_uncertain, ocr_conf,
        {pick(7, "GOOD", "MODERATE", "POOR", "GOOD")} AS quality, CAST(doc_id * 13 % 4 AS INT) AS n_conflicts,
        CASE WHEN n_high >= 4 THEN 'HIGH' WHEN n_high >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS consistency_band, CAST(n_high * 9 + n_medium AS DOUBLE) AS consistency_score,
        doc_id % 3 <> 0 AS ref_available, {pick(3, "LOW", "LOW", "MEDIUM", "LOW", "LOW", "HIGH", "LOW")} AS ref_band, CAST(units % 101 AS DOUBLE) AS ref_score,
        {pick(17, "LOW", "LOW", "MEDIUM", "LOW", "LOW", "LOW", "LOW", "HIGH", "LOW", "LOW", "LOW")} AS ai_band, CAST(units * 3 % 101 AS DOUBLE) AS ai_score,
        {pick(19, "PASS", "PASS", "REVIEW", "PASS", "FAIL", "PASS", "PASS", "PASS")} AS profile_status, {pick(23, "PASS", "", "REVIEW", "", "", "", "MISMATCH", "", "", "PASS", "", "", "")} AS qr_status,
        CAST(n_medium % 3 AS INT) AS n_format_review, CAST(CASE WHEN n_high >= 3 THEN n_high - 2 ELSE 0 END AS INT) AS n_fail, CAST(n % 4 AS INT) AS n_missing,
        {pick(29, "NO_STRONG_EDIT_SIGNAL", "NO_STRONG_EDIT_SIGNAL", "REVIEW_SIGNAL", "NO_STRONG_EDIT_SIGNAL", "INCONCLUSIVE", "", "NO_STRONG_EDIT_SIGNAL", "POSSIBLE_EDITING", "")} AS integrity_status, CAST(units * 7 % 101 AS DOUBLE) AS integrity_score,
        {pick(31, "PASS", "PASS", "PASS", "REVIEW", "PASS", "PASS", "", "PASS", "PASS", "HIGH")} AS security_status, CAST(doc_id * 3 % 6 AS INT) AS security_review_count,
        {pick(37, "NO_FABRICATION_SIGNAL", "NO_FABRICATION_SIGNAL", "SUSPICIOUS_REQUIRES_REVIEW", "NO_FABRICATION_SIGNAL", "FABRICATED_OR_TAMPERED", "NO_FABRICATION_SIGNAL", "NO_FABRICATION_SIGNAL")} AS fab_verdict,
        CAST(n_high / 3 AS INT) AS fab_high, CAST(n_medium / 3 AS INT) AS fab_medium, {pick(41, "LOW", "LOW", "LOW", "REVIEW", "LOW", "HIGH", "LOW", "LOW", "LOW", "LOW", "LOW")} AS verification_overall,
        {pick(43, "PASS", "PASS", "REVIEW", "PASS")} AS cross_status, CAST(doc_id * 2 % 11 AS DOUBLE) AS cross_score, CAST(n % 3 AS INT) AS n_indicators,
        {pick(47, "LOW", "MEDIUM", "LOW", "LOW", "HIGH", "LOW", "LOW")} AS indicator_severity, {pick(53, "MATCH", "MISMATCH", "")} AS face_status, CAST(units % 100 AS DOUBLE) AS face_score
      FROM ({STANDINS["evidence"].replace("CAST(n_", "CAST(n_")}) e"""


STANDINS["cards"] = cards()


def zones() -> str:
    """A passport's zone, a licence's row of dates or a college card's heading per customer, beside the values that each prints."""
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    values = f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'PASSPORT' WHEN c_custkey % 3 = 1 THEN 'DRIVING_LICENSE' ELSE 'COLLEGE_ID' END AS family, c_custkey % 5 AS kind,
        'QUILL' || {LETTERS.format("c_nationkey")} AS surname, 'MIRA' || {LETTERS.format("c_custkey")} AS given, 'Z' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') AS number,
        {two("c_custkey % 100")} AS yy, {two("1 + c_custkey % 12")} AS mm, {two("1 + c_custkey % 28")} AS dd FROM customer"""
    zone = "'P<IND' || surname || '<<' || given || '<RO<<<|' || number || '<4IND' || yy || mm || dd || '7' || CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'M' END || '30' || mm || dd || '2<<<<<<<<<<<<<<<0'"
    row = "'DL No: UP342021' || number || '|Issue Date  Validity (NT)  Validity (TR)|' || dd || '-' || mm || '-2020 ' || dd || '/' || mm || '/2040' || CASE WHEN kind > 1 THEN ' ' || dd || '-' || mm || '-2025' ELSE '' END"
    heading = "CASE WHEN kind = 0 THEN '= ' ELSE '' END || 'Riverside College of 1a Arts' || CASE WHEN kind = 1 THEN '|and Management ' || surname WHEN kind = 2 THEN '|Name: University' ELSE '' END || '|Roll No: 77' || number"
    shown = f"CASE family WHEN 'PASSPORT' THEN CASE WHEN kind = 4 THEN 'Surname: Overton|' ELSE '' END || {zone} WHEN 'DRIVING_LICENSE' THEN {row} ELSE {heading} END"
    return f"SELECT *, replace({shown}, '|', chr(10)) AS text FROM ({values}) v"


STANDINS["zones"] = zones()


def screened() -> str:
    """A document's extracted fields and module statuses in one row, right and wrong in every way that the rules tell apart."""

    def pick(number: int, *values: str | None) -> str:
        cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
        return f"CASE CAST(id * {number} % {len(values)} AS INT) {cases} END"

    digits = lambda n: f"lpad(CAST(id * 7919 % {10**n} AS STRING), {n}, '0')"
    number = f"""CASE WHEN id % 23 = 0 THEN NULL WHEN id % 19 = 0 THEN 'ABCDE1234F' WHEN id % 17 = 0 THEN '7777777' ELSE CASE id_type
        WHEN 'PAN' THEN 'abc' || {pick(1, "P", "C", "Z", "H")} || 'k ' || {digits(4)} || {pick(3, "X", "X", "X", "9", "X")} WHEN 'AADHAAR' THEN CASE WHEN id % 2 = 0 THEN '5820 3617 2943' ELSE {digits(12)} END
        WHEN 'PASSPORT' THEN {pick(5, "U", "U", "U-", "U12", "8")} || CASE WHEN id % 9 = 0 THEN '1234567' ELSE {digits(7)} END WHEN 'DRIVING_LICENSE' THEN 'UP34 ' || CAST(1990 + id % 9 AS STRING) || {digits(5)} || {pick(7, "", "", "X", "")}
        WHEN 'COLLEGE_ID' THEN {pick(11, "BE25CS", "be25cs", "B")} || {digits(3)} WHEN 'NATIONAL_ID' THEN 'AB123456' || {pick(13, "", "6", "7")} ELSE 'V' || {digits(6)} END END"""
    return f"""SELECT id AS doc_id, id_type AS family, CASE WHEN id % 13 > 0 THEN full_name ELSE ' ' END AS name, {number} AS document_number, {pick(3, "INDIAN", None, "INDIAN")} AS nationality, {pick(5, "BTECH", "", "BA")} AS course,
        {pick(7, "2021 - 2025", "2029-2025", "2019-2023", "31/12/2026", "01-01-2020", None, "soon")} AS valid_until, {pick(3, "12/03/1990", "1999-12-31", "31/02/1990", "05-06-1996", None)} AS dob,
        substr(CAST(created_at AS STRING), 1, 10) AS issue_date, {pick(11, "1995-06-30", "30/06/2030", None)} AS validity_nt, {pick(13, "30-06-1990", "2030-01-01", "x", None)} AS validity_tr, {pick(17, "1994-01-01", "2031-01-01")} AS expiry_date,
        {pick(19, "Mirapur 481205", "Mirapur", None, "12345678")} AS address, CAST(id * 11 % 100 AS DOUBLE) AS ocr_conf,
        {pick(23, "Income Tax PAN", "passport nationality", "Name and course", "aadhaar of uidai", "driving", None)} AS text, {pick(29, "PASS", "REVIEW", "FAIL")} AS profile_status, {pick(31, "PASS", "MISMATCH", "UNAVAILABLE", "PASS", None)} AS qr_status,
        {pick(37, "PASS", "HIGH", "REVIEW", "PASS", "PASS")} AS security_status, {pick(41, "NO_STRONG_EDIT_SIGNAL", "POSSIBLE_EDITING", "REVIEW_SIGNAL", "INCONCLUSIVE")} AS integrity_status, {pick(43, "LOW", "MEDIUM", "HIGH")} AS ai_band, CAST(id % 3 AS INT) AS n_ai_signals,
        {pick(47, "PASS", "REVIEW")} AS metadata_status, {pick(53, "PASS", "PASS", "REVIEW")} AS structure_status, {pick(59, "LOW", "", "REVIEW")} AS visual_status, CAST(id % 7 AS INT) AS n_visual FROM ({STANDINS["docs"]}) d"""


STANDINS["screened"] = screened()
#: Integer division differs between the engines: written as floor there.
STANDINS["risk_inputs"] = risk_inputs().replace("CAST(n_high / 3 AS INT)", "CAST(floor(n_high / 3e0) AS INT)").replace("CAST(n_medium / 3 AS INT)", "CAST(floor(n_medium / 3e0) AS INT)")
