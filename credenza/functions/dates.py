"""Date functions as column expressions. Nothing depends on the current date: as-of bounds are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    # A cast reads months and days of one digit, and costs a fraction of a format and its parser.
    whole = F.when(year.cast("int").between(0, 9999), F.lpad(year.cast("int").cast("string"), 4, "0"))
    return F.concat(whole, F.lit("-"), month.cast("int").cast("string"), F.lit("-"), day.cast("int").cast("string")).try_cast("date")


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int")


def strict(x: Column) -> Column:
    """D-M-Y, D/M/Y or Y-M-D; else null."""
    text = F.trim(x)
    dmy, either = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", r"^(?:\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}-\d{1,2}-\d{1,2})$"
    return F.when(F.rlike(text, F.lit(either)), F.regexp_replace(text, dmy, "$3-$2-$1").try_cast("date"))


def pivoted(year: Column, last: int) -> Column:
    """Two-digit years up to `last` are 20xx, others 19xx."""
    return F.when(year >= 100, year).when(year <= last, year + 2000).otherwise(year + 1900)


def numeric(x: Column) -> Column:
    """The text itself, dots as slashes, where it is a calendar date with a two- or four-digit year."""
    text = F.trim(x)
    dmy = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})$"
    found = from_parts(pivoted(_part(text, dmy, 3), 49), _part(text, dmy, 2), _part(text, dmy, 1))
    return F.when(F.rlike(text, F.lit(dmy)) & found.isNotNull(), F.replace(text, F.lit("."), F.lit("/")))


def machine_zone(x: Column) -> Column:
    """YYMMDD to a date."""
    shape = r"^(\d{2})(\d{2})(\d{2})$"
    return F.when(F.rlike(x, F.lit(shape)), from_parts(pivoted(_part(x, shape, 1), 49), _part(x, shape, 2), _part(x, shape, 3)))


def plausible_birth(x: Column, last_year: int) -> Column:
    dmy = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})$"
    year = pivoted(_part(x, dmy, 3), 40)
    return F.coalesce(F.rlike(x, F.lit(dmy)) & from_parts(year, _part(x, dmy, 2), _part(x, dmy, 1)).isNotNull() & year.between(1900, last_year), F.lit(False))


def comparison(x: Column) -> Column:
    """yyyymmdd by ranges only (day up to 31); other text by its lower-case letters and digits."""
    text = F.trim(F.coalesce(x, F.lit("")))
    ymd, dmy = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"

    def joined(pattern: str, y: int, m: int, d: int) -> Column:
        month, day = _part(text, pattern, m), _part(text, pattern, d)
        return F.when(F.rlike(text, F.lit(pattern)) & month.between(1, 12) & day.between(1, 31), F.format_string("%04d%02d%02d", _part(text, pattern, y), month, day))

    return F.coalesce(joined(ymd, 1, 2, 3), joined(dmy, 3, 2, 1), F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))
