"""String normalisers as column expressions. They differ on purpose: each consumer compares by its own rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER_FIELDS = ("document_number", "pan_number", "passport_number", "license_number", "roll_number")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row: a plain reference would be put in at each place of its use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def absent(x: Column) -> Column:
    """Null for null, empty and blank text: applied once, at ingestion."""
    return F.nullif(F.trim(x), F.lit(""))


def document_number(x: Column) -> Column:
    """Trimmed, upper case, letters and digits only."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", ""))


holder_name = document_number


def email(x: Column) -> Column:
    return F.lower(F.trim(x))


def auth_email(x: Column) -> Column:
    """The address, or null where it has no @ or more than 254 characters."""
    return F.when(F.contains(email(x), F.lit("@")) & (F.length(email(x)) <= 254), email(x))


def match_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def comparator_text(field: Column, x: Column) -> Column:
    """Identifiers by letters and digits, dates by digits, the rest squeezed and upper-cased."""
    return (
        F.when(field.isin(*IDENTIFIER_FIELDS), F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))
        .when(field.isin("dob", "valid_until"), F.regexp_replace(x, "[^0-9]", ""))
        .otherwise(F.upper(squeezed(x)))
    )


def consensus_key(field: Column, x: Column) -> Column:
    return (
        F.when(field.isin(*IDENTIFIER_FIELDS), F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))
        .when(field == "dob", F.regexp_replace(x, "[^0-9]", ""))
        .otherwise(F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " ")))
    )


def folded(x: Column) -> Column:
    """Carriage returns, curly quotes, dashes and no-break spaces to their plain forms."""
    return F.translate(F.regexp_replace(x, "\r\n?", "\n"), "‘’“”–—\xa0", "''\"\"-- ")


def humanised(key: Column) -> Column:
    """camelCase and snake_case keys as words."""
    return F.regexp_replace(F.replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")), r"\s+", " ")


def similar_institution(a: Column, b: Column, anchors: tuple[str, ...], least: int = 3) -> Column:
    hits = [F.contains(F.upper(a), F.lit(t)) & F.contains(F.upper(b), F.lit(t)) for t in anchors]
    return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) >= least


def label_like(token: Column, label: str) -> Column:
    """At most one positional difference, the length gap included, for labels of three letters or more."""
    want = "".join(c for c in label.lower() if c.isalnum())
    clean = match_text(token)
    gap = F.abs(F.length(clean) - len(want))
    common = F.least(F.length(clean), F.lit(len(want)))
    positions = F.when(common > 0, F.sequence(F.lit(1), common)).otherwise(F.array().cast("array<int>"))
    wrong = F.size(F.filter(positions, lambda i: F.substr(clean, i, F.lit(1)) != F.substr(F.lit(want), i, F.lit(1))))
    return (F.length(clean) >= 3) & (wrong + gap <= 1) if len(want) >= 3 else clean == want


#: Spellings of the document families. The universal table is used after blanks and hyphens have become
#: underscores and underscores blanks again; the literal one by the value as it is.
LITERAL_FAMILIES = {
    "AADHAR": "AADHAAR", "AADHAAR CARD": "AADHAAR", "AADHAR CARD": "AADHAAR", "PAN CARD": "PAN", "DRIVING LICENSE": "DRIVING_LICENSE", "DRIVING LICENCE": "DRIVING_LICENSE", "DL": "DRIVING_LICENSE",
    "COLLEGE ID": "COLLEGE_ID", "COLLEGE ID CARD": "COLLEGE_ID", "STUDENT ID": "COLLEGE_ID", "STUDENT CARD": "COLLEGE_ID",
    "VISA CARD": "VISA", "TOURIST VISA": "VISA", "ENTRY VISA": "VISA", "WORK VISA": "VISA", "STUDENT VISA": "VISA",
}
UNIVERSAL_FAMILIES = LITERAL_FAMILIES | {"AADAAR": "AADHAAR", "PANCARD": "PAN", "NATIONAL ID": "NATIONAL_ID", "NATIONAL IDENTIFICATION": "NATIONAL_ID", "NATIONAL ID CARD": "NATIONAL_ID", "AUTO": "", "UNIVERSAL": "", "ANY": "", "UNKNOWN": ""}


def _alias(names: dict[str, str], key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), otherwise)


def literal_family(x: Column) -> Column:
    upper = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return _alias(LITERAL_FAMILIES, upper, upper)


def universal_family(x: Column) -> Column:
    joined = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"[\s-]+", "_")
    return _alias(UNIVERSAL_FAMILIES, F.replace(joined, F.lit("_"), F.lit(" ")), joined)


def within_length(x: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(x).between(least, most), F.lit(False))


def instructional(x: Column) -> Column:
    """Text of a form's instructions, which is no address."""
    return F.rlike(x, F.lit(r"(?i)\b(update|upload|submit|click|select|choose|please (enter|provide)|should be updated)\b"))


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def without_keys(value: Column, kind: T.DataType, keys: tuple[str, ...]) -> Column | None:
    """A struct, or array or map of them, without fields of these names at any depth; null where nothing is left."""
    if isinstance(kind, T.StructType):
        kept = [(f.name, without_keys(value[f.name], f.dataType, keys)) for f in kind.fields if f.name not in keys]
        left = [v.alias(n) for n, v in kept if v is not None]
        return F.when(value.isNotNull(), F.struct(*left)) if left else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: without_keys(x, kind.elementType, keys))
    if isinstance(kind, T.MapType):
        return F.map_filter(value, lambda k, _: ~k.isin(*keys))
    return value


def one_time_code(seed: int | None = None) -> Column:
    """Six random digits; the same for a seed, as tests need."""
    return F.lpad(F.floor(F.rand(seed) * 1_000_000).cast("string"), 6, "0")


def case_id() -> Column:
    return F.concat(F.lit("CASE-"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))
