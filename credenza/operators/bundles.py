"""Fields that stand together: a passport's machine-readable zone, a licence's row of dates, the institution in a card's heading.

Each takes texts (doc_id, family, text) and returns rows (doc_id, field, value, source, score) like extraction.extract(), which
joins them. One row of a text in, its fields out: built-ins on the text's lines, no shuffle.

Defined cases: null and empty texts have no rows; of several zones the first counts; a zone whose second line is cut off under
40 characters is none; repeated doc_ids keep their rows apart until extract() picks one value per document and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.functions import dates, text

#: The least length of a zone's second line, places (from 1) and lengths in it, and the letters of sex.
LEAST_ZONE = 40
PLACES = {"document_number": (1, 9), "nationality": (11, 3), "dob": (14, 6), "gender": (21, 1), "expiry_date": (22, 6)}
SEXES = {"M": "MALE", "F": "FEMALE", "<": "UNSPECIFIED"}
#: A date in a row of dates; words of an institution, of its second line, and that begin another field's line.
ROW_DATE = r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"
INSTITUTION, CONTINUED = r"(?i)college|engineering (&|and)", r"(?i)engineering|management|university|lucknow|institute|college"
OTHER_FIELD = r"(?i)^(name|roll|erp|id|course|valid|dob|date|address)\b"
NO_INSTITUTION, LEAST_INSTITUTION = ("college of", "engineering", "management"), 8
SCORES = {"MACHINE_ZONE": 90.0, "DATE_ROW": 88.0, "HEADING": 86.0}


def lines(x: Column) -> Column:
    """The lines that aren't blank, white space squeezed."""
    return F.filter(F.transform(F.split(text.folded(F.coalesce(x, F.lit(""))), "\n"), text.squeezed), lambda line: line != "")


def _long(rows: DataFrame, source: str, values: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in values.items()]))
    return rows.select("doc_id", each.alias("__f")).filter("__f.value IS NOT NULL").select("doc_id", "__f.field", "__f.value", F.lit(source).alias("source"), F.lit(SCORES[source]).alias("score"))


def machine_zones(texts: DataFrame) -> DataFrame:
    """Of texts with a line P<... and a second line of the zone: document_number, nationality, dob, gender, expiry_date, surname,
    given_names and name. Dates are calendar dates (dob as yyyy-MM-dd, expiry as dd-MM-yyyy)."""
    coded = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), r"\r?\n"), lambda line: F.upper(F.regexp_replace(line, r"\s+", ""))), lambda line: F.contains(line, F.lit("<")))
    rows = texts.filter(F.contains(F.upper("text"), F.lit("P<"))).select("doc_id", coded.alias("__l"))
    pairs = F.filter(F.transform("__l", lambda line, i: F.struct(line.alias("first"), F.get("__l", i + 1).alias("second"))), lambda p: F.startswith(p["first"], F.lit("P<")) & (F.length(p["second"]) >= LEAST_ZONE))
    zone = rows.select("doc_id", F.get(pairs, F.lit(0)).alias("__z")).filter("__z IS NOT NULL").select("doc_id", "__z.*")
    part = {name: F.substring("second", *place) for name, place in PLACES.items()}
    letters = lambda c: F.nullif(F.trim(F.regexp_replace(c, "<+", " ")), F.lit(""))
    holder = F.split(F.substring("first", 6, 1 << 30), "<<", 2)
    surname, given = letters(F.get(holder, F.lit(0))), letters(F.coalesce(F.get(holder, F.lit(1)), F.lit("")))
    number = F.replace(part["document_number"], F.lit("<"), F.lit(""))
    nation = F.replace(part["nationality"], F.lit("<"), F.lit(""))
    sex = F.element_at(F.create_map(*[F.lit(x) for pair in SEXES.items() for x in pair]), part["gender"])
    return _long(zone, "MACHINE_ZONE", {
        "document_number": F.when(F.rlike(number, F.lit("^[A-Z0-9]{7,9}$")), number), "nationality": F.when(F.rlike(nation, F.lit("^[A-Z]{3}$")), nation), "gender": sex,
        "dob": F.date_format(dates.machine_zone(part["dob"]), "yyyy-MM-dd"), "expiry_date": F.date_format(dates.machine_zone(part["expiry_date"]), "dd-MM-yyyy"),
        "surname": surname, "given_names": given, "name": F.nullif(F.concat_ws(" ", given, surname), F.lit("")),
    })


def licence_dates(texts: DataFrame) -> DataFrame:
    """Of driving licences: the dates under a line that has the labels of issue and validity, in this order: issue_date,
    validity_nt, validity_tr. Of several such lines the last with that many dates counts."""
    rows = texts.filter("family = 'DRIVING_LICENSE'").select("doc_id", lines(F.col("text")).alias("__l"))
    windows = F.filter(F.transform("__l", lambda line, i: F.struct(line.alias("label"), F.concat_ws(" ", line, F.get("__l", i + 1)).alias("window"))), lambda w: F.rlike(w["label"], F.lit(r"(?i)issue\s*date")) & F.rlike(w["label"], F.lit("(?i)validity")))
    found = rows.select("doc_id", F.transform(windows, lambda w: F.regexp_extract_all(w["window"], F.lit(ROW_DATE), F.lit(1))).alias("__d"))

    def nth(n: int, newest: bool = True) -> Column:
        enough = F.filter("__d", lambda d: F.size(d) >= n)
        return F.get(F.try_element_at(enough, F.lit(-1 if newest else 1)), F.lit(n - 1))

    return _long(found, "DATE_ROW", {"issue_date": nth(1, False), "validity_nt": nth(2), "validity_tr": nth(3)})


def institutions(texts: DataFrame) -> DataFrame:
    """Of college cards: the first line that names an institution, with the next one if that goes on with it."""
    rows = texts.filter("family = 'COLLEGE_ID'").select("doc_id", lines(F.col("text")).alias("__l"))
    following = lambda i: F.coalesce(F.get("__l", i + 1), F.lit(""))
    goes_on = lambda line: F.rlike(line, F.lit(CONTINUED)) & ~F.rlike(line, F.lit(OTHER_FIELD))
    whole = F.transform("__l", lambda line, i: F.when(F.rlike(line, F.lit(INSTITUTION)), F.when(goes_on(following(i)), F.concat_ws(" ", line, following(i))).otherwise(line)))
    edges = r"^[ :#|=-]+|[ :#|=-]+$"

    def clean(value: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(value, edges, ""), "^[^A-Za-z]+", "")
        value = F.regexp_replace(F.regexp_replace(value, r"(?i)\bof\s+(?:ia|1a|la)\b", "of"), r"(?:^|\s)[0O]\s*[%|]+\s*", " ")
        return F.regexp_replace(text.squeezed(value), edges, "")

    cleaned = F.filter(F.transform(F.array_compact(whole), clean), lambda v: (F.length(v) >= LEAST_INSTITUTION) & ~F.lower(v).isin(*NO_INSTITUTION))
    return _long(rows.select("doc_id", F.get(cleaned, F.lit(0)).alias("__i")), "HEADING", {"institution_name": F.col("__i")})
