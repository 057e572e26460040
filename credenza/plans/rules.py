"""Rule and scoring plans as column expressions over evidence columns: nothing here leaves Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the policy.
VERIFY_BELOW, REJECT_FROM, FACE_THRESHOLD = 25, 50, 62.0
#: Vocabulary of the document families (anchors, markers of other families, patterns).
PROFILES = {
    "PAN": (("PAN", "PERMANENT ACCOUNT", "INCOME TAX"), ("AADHAAR", "PASSPORT", "DRIVING LICENCE", "DRIVING LICENSE"), (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",)),
    "AADHAAR": (
        ("AADHAAR", "UIDAI", "UNIQUE IDENTIFICATION", "GOVERNMENT OF INDIA"),
        ("PAN", "PASSPORT", "DRIVING LICENCE", "DRIVING LICENSE", "COLLEGE", "STUDENT", "COURSE", "ROLL", "ERP", "ENGINEERING", "INSTITUTE"),
        (r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", r"\b[0-9]{12}\b"),
    ),
    "PASSPORT": (("PASSPORT", "REPUBLIC OF INDIA", "SURNAME", "GIVEN NAMES", "NATIONALITY"), ("PAN", "AADHAAR", "DRIVING LICENCE", "DRIVING LICENSE"), (r"\b[A-Z][A-Z0-9]{7,8}\b", r"[A-Z0-9<]{20,}<{2,}")),
    "DRIVING_LICENSE": (("DRIVING LICENCE", "DRIVING LICENSE", "TRANSPORT", "DL NO", "VALIDITY"), ("PAN", "AADHAAR", "PASSPORT"), (r"\b[A-Z]{2}\s?[0-9]{2}\s?(?:19|20)[0-9]{2}\s?[0-9]{4,8}\b",)),
    "COLLEGE_ID": (("COLLEGE", "STUDENT", "COURSE", "ROLL", "ERP", "ENGINEERING", "INSTITUTE"), ("PAN", "AADHAAR", "PASSPORT", "DRIVING LICENCE", "DRIVING LICENSE"), (r"\b[A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{3,}\b",)),
    "NATIONAL_ID": (("NATIONAL ID", "NATIONAL IDENTIFICATION", "IDENTITY CARD", "ID CARD"), ("PAN", "AADHAAR", "PASSPORT", "DRIVING LICENCE", "DRIVING LICENSE"), (r"\b[A-Z0-9]{6,20}\b",)),
    "VISA": (("VISA", "ENTRY PERMIT", "IMMIGRATION"), ("PAN", "AADHAAR", "DRIVING LICENCE", "DRIVING LICENSE"), (r"\b[A-Z0-9]{5,20}\b",)),
}


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def total(items: list[Column]) -> Column:
    out = items[0]
    for x in items[1:]:
        out = out + x
    return out


def graded(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def analysis_confidence(ocr: Column, quality: Column, profile: Column, conflicts: Column) -> Column:
    points = (
        F.when(ocr >= 85, 3).when(ocr >= 70, 2).when(ocr >= 55, 1).otherwise(0)
        + F.when(quality.isin("GOOD", "EXCELLENT"), 2).when(quality == "MODERATE", 1).otherwise(0)
        + F.when(profile == "PASS", 1).when(profile == "REVIEW", -1).otherwise(0)
        + F.when(conflicts == 0, 1).when(conflicts >= 2, -1).otherwise(0)
    )
    return F.when(points >= 7, "HIGH").when(points >= 4, "MEDIUM").otherwise("LOW")


def risk(c=F.col) -> dict[str, Column]:
    """Risk columns from one flat row of evidence. Identity and face are gates and never add points.

    Order: points, rounding, module floors, then the low-confidence cap, which overrides the floors.
    """
    semantic = F.when(c("consistency_band") == "HIGH", clamp(half_even(c("consistency_score") * 0.35), 8, 18)).when(c("consistency_band") == "MEDIUM", clamp(half_even(c("consistency_score") * 0.22), 2, 9)).otherwise(0.0)
    reference = F.when(~c("ref_available"), 0.0).when(c("ref_band") == "HIGH", clamp(half_even(c("ref_score") * 0.45), 22, 35)).when(c("ref_band") == "MEDIUM", clamp(half_even(c("ref_score") * 0.28), 5, 14)).when(c("ref_score") > 0, F.least(F.lit(4.0), half_even(c("ref_score") * 0.10))).otherwise(0.0)
    synthetic = F.when(c("ai_band") == "HIGH", clamp(half_even(c("ai_score") * 0.28), 12, 20)).when(c("ai_band") == "MEDIUM", clamp(half_even(c("ai_score") * 0.18), 4, 8)).otherwise(0.0)
    checks = total([
        F.when(c("profile_status") == "FAIL", 10).when(c("profile_status") == "REVIEW", 3).otherwise(0),
        F.when(c("qr_status") == "MISMATCH", 25).when(c("qr_status") == "REVIEW", 2).otherwise(0),
        F.least(F.lit(12), c("n_fail") * 6),
        F.least(F.lit(4), c("n_format_review") * 2),
        F.when(c("ocr_conf") >= 70, F.least(F.lit(4), c("n_missing") * 2)).otherwise(0),
        F.when(c("security_status") == "HIGH", 4).when((c("security_status") == "REVIEW") & (c("security_review_count") >= 3), 2).otherwise(0),
    ])
    fabrication = F.least(F.lit(15), c("fab_high") * 6 + c("fab_medium") * 3)
    verification = F.least(F.lit(35), F.least(F.lit(35), checks) + fabrication)
    integrity = F.when(c("integrity_status") == "POSSIBLE_EDITING", clamp(half_even(c("integrity_score") * 0.22), 10, 15)).when(c("integrity_status") == "REVIEW_SIGNAL", clamp(half_even(c("integrity_score") * 0.12), 3, 8)).otherwise(0.0)
    cross = F.when(c("cross_status") == "REVIEW", F.least(F.lit(8.0), c("cross_score"))).otherwise(0.0)
    indicator = F.when(c("indicator_severity") == "HIGH", F.least(F.lit(10), 8 + F.least(F.lit(2), c("n_indicators")))).when(c("indicator_severity") == "MEDIUM", F.least(F.lit(6), 3 + c("n_indicators"))).when((c("indicator_severity") == "LOW") & (c("n_indicators") > 0), 1).otherwise(0)
    raw = half_even(semantic + reference + synthetic + verification + cross + indicator + integrity)
    high = total([(x).cast("int") for x in (
        c("consistency_band") == "HIGH", c("ref_available") & (c("ref_band") == "HIGH"), c("ai_band") == "HIGH",
        (c("qr_status") == "MISMATCH") | (c("n_fail") >= 2) | (c("verification_overall") == "HIGH") | c("fab_verdict").isin("FABRICATED_OR_TAMPERED", "EDITED_OR_SAMPLE_DOCUMENT"),
        c("indicator_severity") == "HIGH", c("integrity_status") == "POSSIBLE_EDITING", c("security_status") == "HIGH",
    )])
    medium = total([(x).cast("int") for x in (
        c("consistency_band") == "MEDIUM", c("ref_available") & (c("ref_band") == "MEDIUM"), c("ai_band") == "MEDIUM",
        c("profile_status").isin("FAIL", "REVIEW") | (c("qr_status") == "REVIEW") | (c("n_format_review") > 0),
        c("indicator_severity") == "MEDIUM", c("integrity_status").isin("REVIEW_SIGNAL", "INCONCLUSIVE"), c("security_status") == "REVIEW",
    )])
    floored = F.greatest(clamp(raw, 0, 100), F.when(high > 0, 50.0).when(medium > 0, 25.0).otherwise(0.0), F.when(c("qr_status") == "MISMATCH", 50.0).otherwise(0.0))
    confidence = analysis_confidence(c("ocr_conf"), c("quality"), c("profile_status"), c("n_conflicts"))
    strong = (reference >= 22) | (synthetic >= 12) | (c("n_fail") >= 2) | (c("qr_status") == "MISMATCH") | (c("ref_available") & (c("ref_band") == "HIGH")) | (c("profile_status") == "FAIL") | c("fab_verdict").isin("FABRICATED_OR_TAMPERED", "EDITED_OR_SAMPLE_DOCUMENT")
    score = F.when((confidence == "LOW") & ~strong, F.least(floored, F.lit(24.0))).otherwise(floored).cast("int")
    return {
        "risk_score": score,
        "risk_band": F.when(score < VERIFY_BELOW, "Low Risk").when(score < REJECT_FROM, "Review").otherwise("High / Potentially Suspicious"),
        "screening_outcome": F.when(score < VERIFY_BELOW, "LOW_RISK").when(score < REJECT_FROM, "REVIEW").otherwise("HIGH_RISK"),
        "confidence": confidence,
        "identity_gate": F.when(c("n_identity_mismatch") > 0, "FAIL").when(c("n_identity_uncertain") > 0, "REVIEW").otherwise("PASS"),
        "raw_points": raw.cast("int"),
        "verification_points": verification.cast("int"),
    }


def profile(family: Column, text: Column, has_number: Column) -> tuple[Column, Column]:
    """(status, score) of a document family's vocabulary in upper-cased text; UNAVAILABLE for other families."""
    status, score = F.lit("UNAVAILABLE"), F.lit(0)
    upper = F.upper(text)
    for kind, (anchors, others, patterns) in PROFILES.items():
        n_anchor, n_other = (total([F.contains(upper, F.lit(t)).cast("int") for t in terms]) for terms in (anchors, others))
        n_pattern = total([F.rlike(upper, F.lit(p)).cast("int") for p in patterns])
        points = F.when(has_number, 35).otherwise(0) + F.least(F.lit(45), n_anchor * 12) + F.least(F.lit(20), n_pattern * 10)
        conflict = (n_other >= 1) & (n_anchor == 0) & (n_pattern == 0)
        status = F.when(family == kind, F.when(conflict, "FAIL").when(points >= 55, "PASS").otherwise("REVIEW")).otherwise(status)
        score = F.when(family == kind, F.when(conflict, 0).otherwise(F.least(F.lit(100), points))).otherwise(score)
    return status, score


def integrity(c=F.col) -> dict[str, Column]:
    ela_high = (c("ela_outlier_ratio") >= 0.08) & (c("ela_max_z") >= 6)
    ela_medium = ~ela_high & (c("ela_outlier_ratio") >= 0.04) & (c("ela_max_z") >= 5)
    texture_high = (c("texture_outlier_ratio") >= 0.10) & (c("noise_cv") >= 0.75)
    texture_medium = ~texture_high & (c("texture_outlier_ratio") >= 0.05) & (c("noise_cv") >= 0.50)
    uniform = (c("lap_var") >= 700) & (c("texture_cv") < 0.18) & (c("noise_cv") < 0.28)
    score = total([F.when(x, p).otherwise(0) for x, p in ((ela_high, 38), (ela_medium, 18), (texture_high, 34), (texture_medium, 16), (uniform, 16))]) + F.least(F.lit(8), c("n_editing_markers") * 2)
    score = F.least(F.lit(100), score)
    high = ela_high.cast("int") + texture_high.cast("int")
    medium = ela_medium.cast("int") + texture_medium.cast("int") + uniform.cast("int")
    status = F.when((high >= 2) | ((high >= 1) & (medium >= 1)), "POSSIBLE_EDITING").when((high >= 1) | (score >= 45), "REVIEW_SIGNAL").when(score < 20, "NO_STRONG_EDIT_SIGNAL").otherwise("INCONCLUSIVE")
    return {"integrity_score": score, "integrity_status": status}


def synthetic(c=F.col) -> dict[str, Column]:
    texture = F.when((c("texture_outlier_ratio") >= 0.10) & (c("noise_cv") >= 0.75), 22).when((c("texture_outlier_ratio") >= 0.05) & (c("noise_cv") >= 0.50), 10).otherwise(0)
    uniform = F.when((c("lap_var") >= 700) & (c("texture_cv") < 0.18) & (c("noise_cv") < 0.28) & (c("edge_density") >= 0.035), 20).when((c("lap_var") >= 500) & (c("texture_cv") < 0.25) & (c("noise_cv") < 0.40), 9).otherwise(0)
    ela = F.when((c("ela_outlier_ratio") >= 0.08) & (c("ela_max_z") >= 6), 20).when((c("ela_outlier_ratio") >= 0.04) & (c("ela_max_z") >= 5), 9).otherwise(0)
    score = F.least(F.lit(100), texture + uniform + ela)
    return {"synthetic_score": score, "synthetic_band": graded(score, 55, 25)}


def quality_bands(c=F.col) -> dict[str, Column]:
    def band(good: Column, moderate: Column) -> Column:
        return F.when(good, "GOOD").when(moderate, "MODERATE").otherwise("POOR")

    bands = {
        "resolution": band((c("width") >= 1200) & (c("height") >= 800), (c("width") >= 700) & (c("height") >= 450)),
        "brightness_band": band(c("brightness").between(65, 195), c("brightness").between(40, 225)),
        "contrast_band": band(c("contrast") >= 40, c("contrast") >= 22),
        "blur": band(c("laplacian_variance") >= 180, c("laplacian_variance") >= 45),
        "skew": band(F.abs(c("skew_deg")) <= 2.5, F.abs(c("skew_deg")) <= 6),
        "glare": band(c("glare_ratio") < 0.025, c("glare_ratio") < 0.08),
    }
    poor, moderate = (total([(b == kind).cast("int") for b in bands.values()]) for kind in ("POOR", "MODERATE"))
    return bands | {"overall": F.when(poor >= 2, "POOR").when((poor == 1) | (moderate >= 2), "MODERATE").otherwise("GOOD")}


def trust(c=F.col) -> dict[str, Column]:
    points = total([
        F.when(c("c2pa_ai"), -25).when(c("c2pa_signed"), 15).otherwise(0),
        F.when((c("exif_level") == "HIGH") & (c("ai_hits") > 0), -20).when((c("exif_level") == "MEDIUM") & (c("editor_hits") > 0), -10).otherwise(0),
        F.when(c("ela_level") == "HIGH", -22).when(c("ela_level") == "MEDIUM", -11).otherwise(0),
        F.when(c("ocr_level") == "HIGH", -20).otherwise(-F.least(F.lit(8), c("typo_count") * 2) - F.least(F.lit(6), c("missing_count") * 3)),
        F.when(c("dl_ai") >= 80, -30).when(c("dl_ai") >= 60, -18).when(c("dl_ai") >= 45, -8).when(c("dl_ai") <= 20, 10).otherwise(0),
    ])
    score = F.least(F.lit(100), F.greatest(F.lit(0), points + 100))
    return {"trust_points": points, "trust_score": score, "authentic": score >= 70}


def fabrication(c=F.col) -> dict[str, Column]:
    """Verdict by counts of all signals; only `capped` are shown."""
    high, medium = c("n_high"), c("n_medium")
    verdict = F.when((high >= 2) | ((high >= 1) & (medium >= 1)), "FABRICATED_OR_TAMPERED").when((high == 1) | (medium >= 2), "SUSPICIOUS_REQUIRES_REVIEW").otherwise("NO_FABRICATION_SIGNAL")
    return {"fab_verdict": verdict, "n_shown": F.least(F.lit(8), high + medium)}


def module_rollup(high: Column, review: Column) -> Column:
    return F.when(high >= 2, "HIGH").when((high == 1) | (review >= 2), "REVIEW").otherwise("LOW")


def worst_status(mismatch: Column, partial: Column, unknown: Column) -> Column:
    return F.when(mismatch > 0, "MISMATCH").when(partial > 0, "PARTIAL").when(unknown > 0, "UNKNOWN").otherwise("MATCH")


#: Fixed value: verifications of one's own document after the first.
REVERIFICATIONS = 2


def decision(c=F.col) -> Column:
    """The cascade as one ordered expression: the first that applies. reverify_limit: the owner's own document was verified
    REVERIFICATIONS times again already."""
    return (
        F.when(c("screen_only"), "SCREENED")
        .when(c("number").isNull(), "REJECT_NUMBER_MISSING")
        .when(c("number") != c("reference_number"), "REJECT_NUMBER_MISMATCH")
        .when(c("face_score") < FACE_THRESHOLD, "REJECT_FACE")
        .when(c("identity_gate") == "FAIL", "REJECT_IDENTITY")
        .when(c("other_owner"), "CONFLICT_OTHER_OWNER")
        .when(c("reverify_limit"), "CONFLICT_REVERIFY_LIMIT")
        .when(c("risk_score") >= REJECT_FROM, "REJECT_RISK")
        .when(c("risk_score") < VERIFY_BELOW, "VERIFIED")
        .otherwise("PENDING_REVIEW")
    )


#: Fixed values of the face gates: least matches, inliers and score of either kind of descriptor, share of the face covered and zones;
#: correlation and gradient; the score from which faces are somewhat alike.
SIFT, ORB, COVERAGE, ZONES, CORRELATION, GRADIENT, SOMEWHAT = (7, 5, 30), (10, 6, 45), 22, 2, 55, 50, 45


def face_gates(c=F.col) -> dict[str, Column]:
    """Gates of a comparison of two faces, from the columns of the feature table "faces" and its score (0 to 100): local
    evidence (enough matches of either kind that agree in space, over enough of the face) and structure."""
    enough = lambda kind, least: total([(c(f"{kind}{part}") < n).cast("int") for part, n in zip(("_matches", "_inliers", ""), least, strict=True)]) == 0
    local = (c("coverage") >= COVERAGE) & (c("zones") >= ZONES) & (enough("sift", SIFT) | enough("orb", ORB))
    structure = (c("corr") >= CORRELATION) & (c("grad") >= GRADIENT)
    alike = (c("face_score") >= FACE_THRESHOLD) & local & structure
    return {"local_gate": local, "structure_gate": structure, "face_status": F.when(alike, "SIMILAR").when(c("face_score") >= SOMEWHAT, "LOW_SIMILARITY").otherwise("NOT_SIMILAR")}
