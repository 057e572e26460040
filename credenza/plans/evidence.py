"""Rules that make evidence: checks of a document's fields, signals of fabrication, module statuses and field comparison.

Each takes a table with one wide row per document (doc_id, family and the columns that it names; text dates as they
were extracted) and returns long rows, made by one explode of an array of cases: no join, no shuffle. Roll-ups of long rows
group by document; judged() and its steps have all of a document's evidence in its own row, so that nothing is moved.
A bound on dates is an argument; nothing depends on the current date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.functions import dates, identifiers, similarity, text
from credenza.plans import rules

#: Per family the required fields, patterns of fields, and words of which two are expected in the text.
SCHEMAS = {
    "COLLEGE_ID": (("name", "document_number", "course", "valid_until"), {"document_number": r"^BE[0-9]{2}[A-Z]{2}[0-9]{3}$", "valid_until": r"^(19|20)[0-9]{2}\s*-\s*(19|20)[0-9]{2}$"}, ("NAME", "COURSE", "VALID")),
    "PAN": (("name", "document_number"), {"document_number": r"^[A-Z]{5}[0-9]{4}[A-Z]$"}, ("INCOME", "TAX", "PAN")),
    "PASSPORT": (("name", "document_number", "nationality"), {"document_number": r"^[A-Z][0-9]{7}$"}, ("PASSPORT", "NATIONALITY")),
    "DRIVING_LICENSE": (("name", "document_number"), {"document_number": r"^[A-Z0-9 ./-]{6,25}$"}, ("DRIVING", "LICENCE")),
    "AADHAAR": (("name", "document_number"), {"document_number": r"^[0-9]{12}$"}, ("AADHAAR", "UIDAI")),
}
#: Statuses of modules that count as strong and as weak evidence.
STRONG, WEAK = ("HIGH", "MISMATCH", "FAIL"), ("REVIEW", "MEDIUM")
UNREADABLE_BELOW = 70


def _exploded(rows: DataFrame, cases: list[Column], *names: str) -> DataFrame:
    return rows.select("doc_id", F.explode(_listed(cases)).alias("__case")).select("doc_id", *[F.col(f"__case.{n}") for n in names])


def _listed(cases: list[Column]) -> Column:
    return F.array_compact(F.array(*cases))


def present(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def plain(column: str) -> Column:
    """Upper case, letters and digits."""
    return F.upper(F.regexp_replace(F.col(column), "[^A-Za-z0-9]", ""))


def normal(column: str) -> Column:
    return F.upper(text.squeezed(F.col(column)))


def consistency_checks(docs: DataFrame, today: str) -> DataFrame:
    """doc_id, check, status (PASS, REVIEW, FAIL), severity. Reads family, document_number, dob, issue_date, validity_nt,
    validity_tr, expiry_date, valid_until and address; `today` is the date that validity is judged by."""
    return _exploded(with_days(docs), consistency_cases(today), "check", "status", "severity")


DAYS = ("dob", "issue_date", "validity_nt", "validity_tr", "expiry_date", "valid_until")


def with_days(docs: DataFrame) -> DataFrame:
    """Adds the dates of the texts in DAYS, read once a row however many checks compare them."""
    return docs.withColumns({f"__{c}": dates.strict(F.col(c)) for c in DAYS})


def consistency_cases(today: str) -> list[Column]:
    """The checks of a row of with_days()."""
    day = {c: F.col(f"__{c}") for c in DAYS}
    number, family = plain("document_number"), F.col("family")
    digits = F.regexp_replace("document_number", "[^0-9]", "")
    span = r"\b((?:19|20)[0-9]{2})\s*[-–]\s*((?:19|20)[0-9]{2})\b"
    first, last = (F.nullif(F.regexp_extract("valid_until", span, i), F.lit("")).cast("int") for i in (1, 2))
    now = F.to_date(F.lit(today))

    def check(name: str, when: Column, good: Column, bad: str = "FAIL", severity: str = "HIGH") -> Column:
        ok = F.coalesce(good, F.lit(False))
        return F.when(when, F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("status"), F.when(ok, "LOW").otherwise(severity).alias("severity")))

    def ordered(name: str, before: str, after: str, *also: Column) -> Column:
        when = day[before].isNotNull() & day[after].isNotNull()
        for x in also:
            when = when & x
        return check(name, when, day[before] < day[after])

    of = lambda kind: (family == kind) & present("document_number")
    licence = F.rlike(number, F.lit(identifiers.SHAPES["DRIVING_LICENSE"]))
    college = family == "COLLEGE_ID"
    return [
        ordered("DOB_BEFORE_ISSUE", "dob", "issue_date"), ordered("NT_VALIDITY", "issue_date", "validity_nt"), ordered("TR_VALIDITY", "issue_date", "validity_tr"),
        check("AADHAAR_FORMAT", of("AADHAAR") & (F.length(digits) == 12), F.lit(True)),
        check("AADHAAR_CHECKSUM", of("AADHAAR") & (F.length(digits) == 12), identifiers.verhoeff_valid(digits)),
        check("PAN_FORMAT", of("PAN"), F.rlike(F.upper(F.regexp_replace("document_number", r"\s+", "")), F.lit(identifiers.SHAPES["PAN"]))),
        check("DL_FORMAT", of("DRIVING_LICENSE"), licence),
        check("DL_YEAR_CONSISTENCY", of("DRIVING_LICENSE") & licence & day["issue_date"].isNotNull(), F.substring(number, 5, 4).cast("int") == F.year(day["issue_date"]), "REVIEW", "MEDIUM"),
        check("ADDRESS_COMPLETENESS", present("address"), F.rlike("address", F.lit(r"\b[0-9]{6}\b")), "REVIEW", "MEDIUM"),
        check("PASSPORT_FORMAT", of("PASSPORT"), F.rlike(number, F.lit(identifiers.LOOSE_PASSPORT)), "REVIEW", "MEDIUM"),
        ordered("PASSPORT_DATE_ORDER", "issue_date", "expiry_date", of("PASSPORT")),
        check("COLLEGE_ID_VALIDITY_ORDER", college & (last < first), F.lit(False)),
        check("COLLEGE_ID_VALIDITY", college & (last >= first), last >= F.year(now), "REVIEW", "MEDIUM"),
        check("COLLEGE_ID_FORMAT", of("COLLEGE_ID"), F.length(number).between(4, 31), "REVIEW", "MEDIUM"),
        check("COLLEGE_ID_VALIDITY", of("COLLEGE_ID") & day["valid_until"].isNotNull(), day["valid_until"] >= now, "REVIEW", "MEDIUM"),
    ]


def consistency_score() -> Column:
    return F.least(F.lit(100), F.col("n_fail") * 35 + F.col("n_review") * 10)


def consistency_bands(checks: DataFrame) -> DataFrame:
    counts = checks.groupBy("doc_id").agg(F.count_if(F.col("status") == "FAIL").alias("n_fail"), F.count_if(F.col("status") == "REVIEW").alias("n_review"))
    score = consistency_score()
    return counts.select("doc_id", "n_fail", "n_review", score.alias("score"), rules.graded(score, 50, 10).alias("band"))


def schema_checks(docs: DataFrame) -> DataFrame:
    """doc_id, field, status: required fields (MISSING, FORMAT_REVIEW, PASS), then the family's identifier rule (PASS,
    REVIEW where the text is hardly readable, FAIL). Also reads ocr_conf."""
    return _exploded(docs, schema_cases(), "field", "status")


def schema_cases() -> list[Column]:
    cases = []
    for family, (required, patterns, _) in SCHEMAS.items():
        for field in required:
            shaped = F.rlike(normal(field), F.lit(patterns[field])) if field in patterns else F.lit(True)
            status = F.when(~present(field), "MISSING").when(shaped, "PASS").otherwise("FORMAT_REVIEW")
            cases.append(F.when(F.col("family") == family, F.struct(F.lit(field).alias("field"), status.alias("status"))))
    number = F.upper(F.replace("document_number", F.lit(" "), F.lit("")))
    weak = F.coalesce(F.col("ocr_conf"), F.lit(0.0)) < UNREADABLE_BELOW
    rule = {
        "AADHAAR": ("AADHAAR_CHECKSUM", F.when(F.rlike(number, F.lit(identifiers.SHAPES["AADHAAR"])) & identifiers.verhoeff_valid(number), "PASS").when(weak, "REVIEW").otherwise("FAIL")),
        "PAN": ("PAN_FORMAT", F.when(F.rlike(number, F.lit(identifiers.SHAPES["PAN"])), "PASS").otherwise("FAIL")),
        "COLLEGE_ID": ("COLLEGE_ROLL_FORMAT", F.when(F.rlike(number, F.lit(identifiers.SHAPES["COLLEGE_ID"])), "PASS").otherwise("FAIL")),
    }
    return cases + [F.when((F.col("family") == family) & present("document_number"), F.struct(F.lit(name).alias("field"), status.alias("status"))) for family, (name, status) in rule.items()]


IDENTIFIER_RULES = ("AADHAAR_CHECKSUM", "PAN_FORMAT", "COLLEGE_ROLL_FORMAT")


def keyword_status(docs: DataFrame) -> DataFrame:
    """doc_id, keyword_hits, keyword_status: at least two of the family's words in the text."""
    hits, status = keyword_columns()
    return docs.select("doc_id", hits.alias("keyword_hits"), status.alias("keyword_status"))


def keyword_columns() -> tuple[Column, Column]:
    upper = normal("text")
    hits = F.lit(None).cast("int")
    for family, (_, _, words) in SCHEMAS.items():
        hits = F.when(F.col("family") == family, rules.total([F.contains(upper, F.lit(w)).cast("int") for w in words])).otherwise(hits)
    return hits, F.when(hits.isNull(), "NOT_CONFIGURED").when(hits >= 2, "PASS").otherwise("REVIEW")


def _failed(field: Column, status: Column) -> dict[str, Column]:
    return {"rule_failed": field.isin(*IDENTIFIER_RULES) & (status == "FAIL"), "field_failed": status.isin("MISSING", "FORMAT_REVIEW", "FAIL")}


def fabrication_signals(docs: DataFrame, schema: DataFrame) -> DataFrame:
    """doc_id, signal, severity. docs: family, document_number and the statuses keyword_status, profile_status, qr_status,
    security_status, integrity_status, ai_band, n_ai_signals, consistency_band, and visual_signals
    (array<struct<type, severity>>, of which four are taken); schema: the rows of schema_checks()."""
    failed = schema.groupBy("doc_id").agg(*[F.bool_or(v).alias(k) for k, v in _failed(F.col("field"), F.col("status")).items()])
    return signals_of(docs.join(failed, "doc_id", "left").withColumn("signals", signal_list()))


def signals_of(rows: DataFrame) -> DataFrame:
    # A plain explode would filter on the size of the list first, and so make all that is in it several times.
    return rows.select("doc_id", F.explode_outer("signals").alias("__case")).filter("__case IS NOT NULL").select("doc_id", "__case.signal", "__case.severity")


def signal_list() -> Column:
    """The signals of a row that also has rule_failed and field_failed."""
    number = F.upper(F.regexp_replace(F.coalesce("document_number", F.lit("")), r"\s+", ""))

    def signal(name: str, severity: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity")))

    cases = _listed([
        signal("PLACEHOLDER_IDENTIFIER", "HIGH", identifiers.placeholder(number)),
        signal("SEQUENTIAL_OR_REPEATED_IDENTIFIER", "HIGH", identifiers.sequential_or_repeated(number)),
        signal("DOCUMENT_TYPE_SAMPLE_IDENTIFIER", "HIGH", (number != "") & identifiers.sample_number(F.col("family"), number)),
        signal("IDENTIFIER_RULE_FAILURE", "HIGH", F.col("rule_failed")),
        signal("PAN_CATEGORY_CONTRADICTION", "HIGH", (F.col("family") == "PAN") & (F.length(number) == 10) & ~identifiers.pan_category_ok(number)),
        signal("FIELD_CONTRADICTION", "HIGH", F.col("field_failed")),
        signal("TEMPLATE_CONTRADICTION", "MEDIUM", (F.col("keyword_status") == "REVIEW") & F.col("profile_status").isin("FAIL", "REVIEW")),
        signal("ENCODED_DATA_MISMATCH", "HIGH", F.col("qr_status") == "MISMATCH"),
        signal("SECURITY_FEATURE_CONTRADICTION", "HIGH", F.col("security_status") == "HIGH"),
        signal("SECURITY_FEATURE_REVIEW", "MEDIUM", F.col("security_status") == "REVIEW"),
        signal("LOCAL_EDITING_EVIDENCE", "HIGH", F.col("integrity_status") == "POSSIBLE_EDITING"),
        signal("LOCAL_EDITING_REVIEW", "MEDIUM", F.col("integrity_status") == "REVIEW_SIGNAL"),
        signal("SYNTHETIC_IMAGE_EVIDENCE", "MEDIUM", F.col("ai_band").isin("HIGH", "MEDIUM") & (F.col("n_ai_signals") > 0)),
        signal("CROSS_FIELD_CONTRADICTION", "HIGH", F.col("consistency_band") == "HIGH"),
        signal("CROSS_FIELD_REVIEW", "MEDIUM", F.col("consistency_band") == "MEDIUM"),
    ])
    visual = F.transform(F.slice(F.coalesce(F.col("visual_signals"), F.array().cast("array<struct<type:string,severity:string>>")), 1, 4), lambda v: F.struct(v["type"].alias("signal"), v["severity"].alias("severity")))
    return F.concat(cases, visual)


def judged(docs: DataFrame, today: str) -> DataFrame:
    """docs with all that the rules find, in its own row: keyword_hits and keyword_status, consistency_band (null without a check),
    rule_failed and field_failed, schema_status and signals. Reads what consistency_checks(), schema_checks(), keyword_status()
    and fabrication_signals() read."""
    count = lambda c, status: F.size(F.filter(c, lambda x: x["status"] == status))
    hits, keywords = keyword_columns()
    rows = with_days(docs).withColumns({"__checks": _listed(consistency_cases(today)), "__schema": _listed(schema_cases()), "keyword_hits": hits, "keyword_status": keywords})
    failed = lambda kind: F.exists("__schema", lambda x: _failed(x["field"], x["status"])[kind])
    rows = rows.withColumns({"n_fail": count("__checks", "FAIL"), "n_review": count("__checks", "REVIEW"), "rule_failed": failed("rule_failed"), "field_failed": failed("field_failed")})
    band = F.when(F.size("__checks") > 0, rules.graded(consistency_score(), 50, 10))
    rows = rows.withColumns({"consistency_band": band, "schema_status": F.when(F.col("field_failed"), "REVIEW").otherwise("PASS")})
    return rows.withColumn("signals", signal_list()).drop("__checks", "__schema", "n_fail", "n_review", *(f"__{c}" for c in DAYS))


def fabrication_status(rows: DataFrame) -> DataFrame:
    """rows: signals. Adds n_high, n_medium, fab_verdict, fab_status."""
    count = lambda severity: F.size(F.filter("signals", lambda x: x["severity"] == severity)).cast("bigint")
    rows = rows.withColumns({"n_high": count("HIGH"), "n_medium": count("MEDIUM")})
    verdict, status = _fabrication()
    return rows.withColumns({"fab_verdict": verdict, "fab_status": status})


def _fabrication() -> tuple[Column, Column]:
    verdict = rules.fabrication()["fab_verdict"]
    return verdict, F.when(verdict == "FABRICATED_OR_TAMPERED", "HIGH").when(verdict == "SUSPICIOUS_REQUIRES_REVIEW", "REVIEW").otherwise("LOW")


def fabrication_verdicts(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id, n_high, n_medium, fab_verdict, fab_status of every document, by its signals."""
    counts = signals.groupBy("doc_id").agg(F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium"))
    rows = docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["n_high", "n_medium"])
    verdict, status = _fabrication()
    return rows.select("doc_id", "n_high", "n_medium", verdict.alias("fab_verdict"), status.alias("fab_status"))


#: The columns that hold modules' statuses, by module.
MODULES = {
    "schema": "schema_status", "template": "keyword_status", "document_profile": "profile_status", "qr": "qr_status", "metadata": "metadata_status", "structure": "structure_status",
    "security": "security_status", "synthetic": "ai_band", "integrity": "integrity_status", "visual_forgery": "visual_status", "fabrication": "fab_status",
}


def module_statuses(docs: DataFrame) -> DataFrame:
    """doc_id, module, status: a missing status is UNAVAILABLE; the issuer is NOT_CONFIGURED."""
    return _exploded(docs, module_cases(), "module", "status")


def module_cases() -> list[Column]:
    cases = [F.struct(F.lit(m).alias("module"), F.coalesce(F.nullif(F.upper(F.trim(F.col(c))), F.lit("")), F.lit("UNAVAILABLE")).alias("status")) for m, c in MODULES.items()]
    return [*cases, F.struct(F.lit("issuer").alias("module"), F.lit("NOT_CONFIGURED").alias("status"))]


def verification(modules: DataFrame) -> DataFrame:
    """doc_id, overall, n_high, n_review, n_unavailable."""
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    sums = modules.groupBy("doc_id").agg(count(*STRONG).alias("n_high"), count(*WEAK).alias("n_review"), count("UNAVAILABLE", "NOT_CONFIGURED").alias("n_unavailable"))
    return sums.select("doc_id", rules.module_rollup(F.col("n_high"), F.col("n_review")).alias("overall"), "n_high", "n_review", "n_unavailable")


def verified(rows: DataFrame) -> DataFrame:
    """As verification(), of rows that have the columns of MODULES."""
    count = lambda *kinds: F.size(F.filter("__modules", lambda x: x["status"].isin(*kinds))).cast("bigint")
    sums = rows.select("doc_id", F.array(*module_cases()).alias("__modules")).select("doc_id", count(*STRONG).alias("n_high"), count(*WEAK).alias("n_review"), count("UNAVAILABLE", "NOT_CONFIGURED").alias("n_unavailable"))
    return sums.select("doc_id", rules.module_rollup(F.col("n_high"), F.col("n_review")).alias("overall"), "n_high", "n_review", "n_unavailable")


def compare_fields(pairs: DataFrame, close: float = 0.70) -> DataFrame:
    """pairs: doc_id, field, reference, extracted. Adds status: NOT_APPLICABLE, UNKNOWN, MATCH, PARTIAL (similar) or
    MISMATCH. Dates of birth are compared as dates."""
    key = lambda c: F.when(F.col("field") == "dob", dates.comparison(F.col(c))).otherwise(text.match_text(F.trim(c)))
    judged = similarity.with_ratio(pairs, text.match_text(F.trim("reference")), text.match_text(F.trim("extracted")), close)
    status = (
        F.when(F.col("reference").isNull() | F.col("extracted").isNull() | (F.trim("reference") == ""), "NOT_APPLICABLE")
        .when(F.trim("extracted") == "", "UNKNOWN").when(key("reference") == "", "NOT_APPLICABLE").when(key("reference") == key("extracted"), "MATCH")
        .when(F.col("ratio") >= close, "PARTIAL").otherwise("MISMATCH")
    )
    return judged.select("doc_id", "field", "reference", "extracted", status.alias("status"))


def identity_gates(compared: DataFrame) -> DataFrame:
    """doc_id, n_mismatch, n_uncertain and the worst status of a document's compared fields."""
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    sums = compared.groupBy("doc_id").agg(count("MISMATCH").alias("n_mismatch"), count("PARTIAL").alias("n_partial"), count("UNKNOWN").alias("n_unknown"))
    return sums.select("doc_id", "n_mismatch", (F.col("n_partial") + F.col("n_unknown")).alias("n_uncertain"), rules.worst_status(F.col("n_mismatch"), F.col("n_partial"), F.col("n_unknown")).alias("worst"))
