"""Identifier checks and finders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credenza.functions.text import bound

#: The first permutation of the Verhoeff scheme, identifier shapes, placeholders, category letters, sample
#: numbers. Digits are [0-9], as \\d takes other scripts' digits too in some engines.
FIRST_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
SHAPES = {
    "PAN": r"^[A-Z]{5}[0-9]{4}[A-Z]$", "AADHAAR": r"^[0-9]{12}$", "PASSPORT": r"^[A-Z][0-9]{7}$",
    "DRIVING_LICENSE": r"^[A-Z]{2}[0-9]{2}(19|20)[0-9]{2}[0-9]{4,8}$", "COLLEGE_ID": r"^BE[0-9]{2}[A-Z]{2}[0-9]{3}$",
}
LOOSE_PASSPORT = r"^[A-Z][A-Z0-9]{7,8}$"
PLACEHOLDERS = ("ABCDE1234F", "123456789012", "1234567890", "U1234567", "AAAPL1234C", "000000000000", "111111111111", "123412341234")
PAN_CATEGORIES = "PCHFATBLJ"
SAMPLES = {
    "PASSPORT": (r"^[A-Z]1234567$", r"^[A-Z]0000000$"),
    "DRIVING_LICENSE": (r"^(DL)?0{4,}$", r"^[A-Z]{2}[0-9]{2}(19|20)000000$"),
    "COLLEGE_ID": (r"^(ID|STUDENT|ROLL)?0{4,}$", r"^[A-Z]{2}[0-9]{2}[A-Z]{2}000+$"),
    "NATIONAL_ID": (r"^0{6,}$", r"^[A-Z0-9]{2}123456+$"),
    "VISA": (r"^0{5,}$", r"^[A-Z]{2}123456+$"),
}


def dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: rotations 0 to 4, reflections 5 to 9."""
    rotation = (a % 5 + b % 5) % 5 if a < 5 else (a % 5 - b % 5) % 5
    return rotation + 5 * ((a >= 5) != (b >= 5))


def permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([FIRST_PERMUTATION[x] for x in rows[-1]])
    return rows


def verhoeff_valid(number: Column) -> Column:
    """Whether the digits of number, from the right, multiply to the identity. False without digits."""
    product = F.array(*[F.lit(dihedral(a, b)) for a in range(10) for b in range(10)])
    permuted = F.array(*[F.lit(x) for row in permutations() for x in row])

    def identity(digits: Column) -> Column:
        positions = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits))).otherwise(F.array().cast("array<int>"))
        step = lambda c, i: F.get(product, c * 10 + F.get(permuted, (i - 1) % 8 * 10 + F.substr(digits, i, F.lit(1)).cast("int")))
        return (F.length(digits) > 0) & (F.aggregate(positions, F.lit(0), step) == 0)

    # The digits are taken out once a number, not once a step.
    return bound(F.reverse(F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")), identity)


def first_valid_12_digits(text: Column) -> Column:
    """The first run of 12 digits (bare, or in fours) that passes the checksum, digits only; else null."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})(?![0-9])"), 1)
    return F.get(F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[ -]", "")), verhoeff_valid), F.lit(0))


def shaped(kind: str, number: Column) -> Column:
    return F.rlike(number, F.lit(SHAPES[kind]))


def pan_category_ok(number: Column) -> Column:
    return F.contains(F.lit(PAN_CATEGORIES), F.substring(number, 4, 1))


def placeholder(number: Column) -> Column:
    return number.isin(*PLACEHOLDERS)


def sequential_or_repeated(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    twice = F.concat(digits, digits)
    run = F.contains(twice, F.lit("0123456789")) | F.contains(twice, F.lit("9876543210"))
    return (F.length(digits) >= 6) & (run | F.rlike(digits, F.lit(r"^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$")))


def sample_number(family: Column, number: Column) -> Column:
    out = F.lit(False)
    for kind, patterns in SAMPLES.items():
        for pattern in patterns:
            out = out | ((family == kind) & F.rlike(number, F.lit(pattern)))
    return out


def repaired_pan(candidate: Column) -> Column:
    """Ten characters with letters and digits that OCR confuses set right by position."""
    letters = lambda x: F.translate(x, "012568", "OIZSGB")
    digits = lambda x: F.translate(x, "OIZSGB", "012568")
    return F.concat(letters(F.substring(candidate, 1, 5)), digits(F.substring(candidate, 6, 4)), letters(F.substring(candidate, 10, 1)))


#: Digits that stand for letters where a letter belongs, and letters that stand for digits, in a window of a
#: recognised number; its length.
WINDOW_LETTERS, WINDOW_DIGITS, PAN_LENGTH = ("012568", "OIZSGB"), ("OQDILZSB", "00011258"), 10


def windowed_pan(raw: Column) -> Column:
    """The first run of ten of the letters and digits of a recognised piece (one field's text, not a page) that is a number once
    confusable characters are set right by position."""
    plain = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")

    def mended(window: Column) -> Column:
        letters = lambda x: F.translate(x, *WINDOW_LETTERS)
        return F.concat(letters(F.substring(window, 1, 5)), F.translate(F.substring(window, 6, 4), *WINDOW_DIGITS), letters(F.substring(window, 10, 1)))

    places = lambda text: F.when(F.length(text) >= PAN_LENGTH, F.sequence(F.lit(1), F.length(text) - PAN_LENGTH + 1)).otherwise(F.array().cast("array<int>"))
    windows = lambda text: F.transform(places(text), lambda i: mended(F.substring(text, i, PAN_LENGTH)))
    return bound(plain, lambda text: F.get(F.filter(windows(text), lambda w: F.rlike(w, F.lit("^[A-Z]{5}[0-9]{4}[A-Z]$"))), F.lit(0)))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def find_pan(upper: Column) -> Column:
    """A labelled number first, then any."""
    shape = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
    return F.coalesce(_found(upper, r"(?:PAN|PERMANENT\s+ACCOUNT)\s*(?:NO|NUMBER|CARD)?[^A-Z0-9]*" + shape), _found(upper, shape))


def find_passport(upper: Column) -> Column:
    shape = r"\b([A-Z][0-9]{7})\b"
    return F.coalesce(_found(upper, r"PASSPORT\s*(?:NO|NUMBER)?[^A-Z0-9]*" + shape), _found(upper, shape))


def licence_shaped(number: Column) -> Column:
    """Twelve characters or more, two letters first, with a year in them."""
    return (F.length(number) >= 12) & F.rlike(number, F.lit(r"^[A-Z]{2}[0-9]{2}[0-9]*(19|20)[0-9]{2}"))


def find_licence(upper: Column) -> Column:
    """Labelled, then with spaces or dashes, then closed up."""
    labelled = F.regexp_replace(_found(upper, r"(?:DL|LICEN[CS]E)\s*(?:NO|NUMBER)?[ .:]*([A-Z]{2}[ -]?[0-9][0-9 -]{8,18}[0-9])"), "[^A-Z0-9]", "")
    spaced = F.regexp_replace(_found(upper, r"\b([A-Z]{2}[ -]?[0-9]{2}[ -]?(?:19|20)[0-9]{2}[ -]?[0-9]{4,8})\b"), "[^A-Z0-9]", "")
    return F.coalesce(F.when(licence_shaped(labelled), labelled), F.when(licence_shaped(spaced), spaced))


def find_college_id(upper: Column) -> Column:
    """By label (roll, then enrolment and registration, then student id; a word of its own, so not the letters of another
    number), the longest of the best label; else the longest mixed word of the college shape."""
    ranked = [F.regexp_extract_all(upper, F.lit(rf"(?<![A-Z0-9]){label}\s*(?:NO|NUMBER|ID)?(?![A-Z])[^A-Z0-9\n]*([A-Z0-9][A-Z0-9/-]*[0-9][A-Z0-9/-]*)"), 1) for label in ("ROLL", "(?:ENROL+MENT|REGISTRATION)", "STUDENT")]
    longest = lambda found: F.get(F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]), F.lit(0))
    return F.coalesce(*map(longest, ranked), longest(F.regexp_extract_all(upper, F.lit(r"\b([A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{3,})\b"), 1)))


def find_visa(upper: Column) -> Column:
    return _found(upper, r"VISA\s*(?:NO|NUMBER)?[^A-Z0-9\n]*([A-Z0-9]{5,20})\b")


def find_labelled(upper: Column) -> Column:
    """A number after a document label; bare numbers of 16 digits are card numbers and not taken."""
    found = _found(upper, r"(?:DOCUMENT|IDENTITY|CERTIFICATE|SERIAL|CARD|ID)\s*(?:NO|NUMBER)[^A-Z0-9\n]*([A-Z0-9][A-Z0-9/-]{3,})")
    return F.when(~F.rlike(found, F.lit("^[0-9]{16}$")), found)


def mrz_name(text: Column) -> Column:
    """Given names and surname of a passport's first machine-readable line; fillers are blanks."""
    lines = F.transform(F.split(F.upper(text), "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    line = F.get(F.filter(lines, lambda x: F.rlike(x, F.lit("^P<[A-Z]{3}.*<<"))), F.lit(0))
    part = lambda i: F.trim(F.regexp_replace(F.regexp_extract(line, r"^P<[A-Z]{3}([A-Z<]*?)<<([A-Z<]+)", i), "<+", " "))
    name = F.trim(F.concat_ws(" ", part(2), part(1)))
    return F.when(F.rlike(name, F.lit(r"^[A-Z][A-Z .'-]{2,80}$")), name)


def mrz_number(text: Column) -> Column:
    """The number that opens a passport's second machine-readable line."""
    lines = F.transform(F.split(F.upper(text), "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    line = F.get(F.filter(lines, lambda x: F.rlike(x, F.lit("^[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{6}[0-9][MFX<][0-9]{6}"))), F.lit(0))
    return F.nullif(F.replace(F.substring(line, 1, 9), F.lit("<"), F.lit("")), F.lit(""))
