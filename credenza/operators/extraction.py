"""Field extraction as a plan over lines: text to (doc_id, field, value, source, score), with built-ins only.

A text becomes lines; each line is cut at its labels by one pattern; a label's candidates are the rest of its
line, its column of a value row, the next lines up to another label, or (addresses) those lines together. Every
candidate is cleaned by its field's kind, and the best of each document and field stays. Windows and groups are
documents, so a text of many lines is the largest group. References, where given, repair names (see repaired()).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credenza.functions import dates, identifiers, similarity, text
from credenza.operators import bundles

#: Per field its kind and its labels, in order of preference.
FIELDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "name": ("name", ("full name", "holder name", "applicant name", "candidate name", "student name", "cardholder name", "person name", "name")),
    "father_name": ("name", ("father's name", "fathers name", "father name", "father")),
    "mother_name": ("name", ("mother's name", "mothers name", "mother name", "mother")),
    "relation_name": ("relation", ("son / daughter / wife of", "relation name", "guardian name", "spouse name", "husband name", "wife name", "relation", "s/o", "d/o", "w/o", "c/o")),
    "dob": ("date", ("date of birth", "birth date", "d.o.b", "dob")),
    "gender": ("gender", ("gender", "sex")),
    "document_number": ("identifier", ("document no", "document number", "document id", "identity no", "identity number", "id no", "id number", "card no", "card number", "certificate no", "certificate number", "serial no", "serial number", "licence no", "licence number", "license no", "license number", "dl no")),
    "aadhaar_number": ("identifier", ("aadhaar no", "aadhaar number", "aadhar no", "aadhar number", "uid no", "uid number", "unique identification number")),
    "pan_number": ("identifier", ("permanent account no", "permanent account number", "pan no", "pan number")),
    "passport_number": ("identifier", ("passport no", "passport number", "passport id")),
    "visa_number": ("identifier", ("visa no", "visa number", "visa id")),
    "roll_number": ("identifier", ("roll no", "roll number", "roll id")),
    "enrollment_number": ("identifier", ("enrollment no", "enrollment number", "enrolment no", "enrolment number")),
    "registration_number": ("identifier", ("registration no", "registration number", "reg no")),
    "erp_id": ("identifier", ("erp id", "erp no", "erp number")),
    "national_id_number": ("identifier", ("national id no", "national id number", "national identity number", "identity card no", "identity card number", "nid no", "nid number")),
    "address": ("address", ("permanent address", "residential address", "present address", "address")),
    "issue_date": ("date", ("date of issue", "issue date", "issued on", "date issued")),
    "expiry_date": ("date", ("date of expiry", "date of expiration", "expiry date", "expiration date", "valid upto", "valid until", "valid till")),
    "validity_nt": ("date", ("non transport validity", "validity (nt)", "nt validity")),
    "validity_tr": ("date", ("transport validity", "validity (tr)", "tr validity")),
    "passing_year": ("year", ("year of passing", "passing year", "year of examination", "passed in")),
    "institution_name": ("text", ("institution name", "college name", "university name", "name of school", "school name")),
    "course": ("text", ("course", "programme", "program", "branch", "department")),
    "nationality": ("text", ("nationality",)),
    "surname": ("surname", ("surname", "family name", "last name")),
    "given_names": ("surname", ("given names", "given name", "first name", "forename")),
    "place_of_birth": ("text", ("place of birth", "birth place")),
    "place_of_issue": ("text", ("place of issue", "issue place")),
    "blood_group": ("blood_group", ("blood group", "blood grp")),
    "organ_donor": ("yes_no", ("organ donor",)),
    "phone": ("phone", ("phone no", "phone number", "mobile no", "mobile number", "contact no", "contact number")),
    "email": ("email", ("e-mail", "email address", "email")),
    "pincode": ("postal_code", ("pin code", "postal code", "zip code")),
    "issuing_authority": ("text", ("issuing authority", "issued by")),
}
#: Words that are no part of a name, and lines that are no value.
NOT_NAMES = ("name", "full", "holder", "candidate", "student", "cardholder", "father", "mother", "male", "female", "gender", "sex", "address", "dob", "date", "birth", "nationality", "passport", "aadhaar", "pan", "valid", "till", "validity", "phone", "mobile", "email", "college", "university", "school", "certificate", "board", "roll", "number", "id", "government", "india")
FOOTERS = r"(?i)\b(valid\s+unless\s+physically\s+signed|important\s+instructions|see\s+overleaf|cum\s*-?\s*marks)\b"
#: What ends a name and an address on their line.
AFTER_NAME = r"(?i)\b(date\s*of\s*birth|dob|gender|sex|address|nationality|valid\s*(till|until)|issue\s*date|expiry\s*date|phone|mobile|email)\b.*$"
AFTER_ADDRESS = r"(?i)\b(date\s*of\s*birth|dob|gender|sex|phone|mobile|e-?mail)\b.*$"
INSTRUCTIONS = r"(?i)\b(please\s+(enter|provide)|should\s+be\s+updated|update|upload|submit|click|select|choose)\b.*$"
RELATIONS = r"(?i)^\s*(son\s*/\s*daughter\s*/\s*wife\s*of|[sdwc]\s*/\s*o|(son|daughter|wife|husband)\s+of|father|mother|relation|guardian)\b\s*[:=-]?\s*"
NO_IDENTIFIERS = ("AADHAAR", "AADHAR", "PAN", "PASSPORT", "VISA", "ROLL", "NUMBER", "NO", "ID", "CARD", "DOCUMENT", "CERTIFICATE", "DATE", "DOB", "NA")
#: Fields that also stand for the document's number, and scores of a candidate by where it stands.
NUMBERS = ("aadhaar_number", "pan_number", "passport_number", "visa_number", "roll_number", "national_id_number")
SCORES = {"SAME_LINE": 96.0, "NEXT_LINE": 84.0, "VALUE_ROW": 80.0, "MULTI_LINE": 78.0}
EDGES = r"[\s:;#=|/\\.-]+"
#: Lines after a label that are looked at.
AHEAD = 5


def label_key(label: str) -> str:
    return "".join(c for c in label.lower() if c.isalpha())


def label_pattern(phrases: list[str]) -> str:
    """The phrases, longest first, with any white space, dots and apostrophes, where no letter stands beside them."""

    def one(phrase: str) -> str:
        out = "".join({" ": r"\s*", "'": "['’]?", ".": r"\.?\s*", "/": r"\s*/\s*", "-": r"[-\s]?", "(": r"\(?", ")": r"\)?"}.get(c, c) for c in phrase)
        return out + (r"\.?" if phrase.endswith(" no") else "")

    return r"(?i)(?<![\p{L}\p{N}_])((?:" + "|".join(one(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r"))(?=$|[\s:=#|–—;,/(\[<0-9-])"


LABEL = label_pattern([p for _, phrases in FIELDS.values() for p in phrases])
FIELD_OF = {label_key(p): field for field, (_, phrases) in FIELDS.items() for p in phrases}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def stripped(x: Column) -> Column:
    """Without separators at either end; white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, rf"^{EDGES}|{EDGES}$", ""), r"\s+", " "))


def without_label(x: Column) -> Column:
    return stripped(F.regexp_replace(stripped(x), LABEL.replace("(?i)", "(?i)^", 1), ""))


def meaningful(x: Column) -> Column:
    return F.rlike(stripped(x), F.lit("[A-Za-z0-9@]"))


def blank_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    return blank_null(F.regexp_extract(x, pattern, group))


def clean_name(x: Column, least_words: int = 2) -> Column:
    """Two to six words (five of more) that are no labels; of words in capitals, what follows in small letters is noise."""
    body = F.regexp_replace(without_label(x), RELATIONS, "")
    body = F.regexp_replace(body, AFTER_NAME, "")
    found = F.filter(F.regexp_extract_all(body, F.lit(r"([A-Za-z][A-Za-z.'-]*)"), 1), lambda w: ~F.lower(w).isin(*NOT_NAMES))
    capital = lambda w: w == F.upper(w)
    plain = lambda words: F.when(F.forall(F.slice(words, 1, 2), capital) & (F.size(words) >= 2), F.filter(words, capital)).otherwise(words)
    some = lambda words: F.when(F.size(words) > 6, F.slice(words, 1, 5)).otherwise(words)
    whole = lambda words: F.when((F.size(words) >= least_words) & ~F.exists(words, lambda w: F.length(w) == 1), blank_null(F.regexp_replace(F.array_join(words, " "), r"^[ .'-]+|[ .'-]+$", "")))
    return F.when(~F.rlike(x, F.lit(FOOTERS)), text.bound(found, lambda f: text.bound(plain(f), lambda p: text.bound(some(p), whole))))


def clean_relation(x: Column) -> Column:
    """A relative's name; what follows the first digit is an address."""
    return clean_name(F.regexp_replace(without_label(x), r"\s*[0-9].*$", ""))


def clean_date(x: Column) -> Column:
    def of(body: Column) -> Column:
        numeric = F.regexp_replace(F.regexp_extract(body, r"(?<![0-9])([0-9]{1,4}\s*[-/.]\s*[0-9]{1,2}\s*[-/.]\s*[0-9]{1,4})(?![0-9])", 1), r"\s+", "")
        day = text.bound(numeric, lambda n: F.coalesce(dates.numeric(n), F.when(dates.strict(n).isNotNull(), F.replace(n, F.lit("."), F.lit("/")))))
        words = F.rlike(body, F.lit(r"(?i)\b(19|20)[0-9]{2}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"))
        return F.coalesce(day, F.when(words & (F.length(body) <= 60), body))

    return text.bound(without_label(x), of)


def clean_address(x: Column) -> Column:
    """Without a relative's prefix and from instructions on; five characters and a word of two letters at least."""
    body = F.regexp_replace(F.regexp_replace(without_label(x), RELATIONS, ""), INSTRUCTIONS, "")
    body = F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"^[ .,:;-]+|[ .,:;-]+$", "")
    return text.bound(body, lambda b: F.when((F.length(b) >= 5) & F.rlike(b, F.lit("[A-Za-z]{2,}")), b))


def clean_identifier(x: Column, field: Column, family: Column) -> Column:
    kind = F.when(field == "document_number", F.lower(family)).otherwise(F.regexp_replace(field, "_number$", ""))

    def of(parts: Column) -> Column:
        body, compact, digits, size = parts["body"], parts["compact"], parts["digits"], F.length(parts["compact"])
        bad = compact.isin("", *NO_IDENTIFIERS) | F.rlike(compact, F.lit("^(19|20)[0-9]{2}$")) | F.rlike(body, F.lit(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|(?i)\b(not\s+available|unknown|na|nil|none)\b"))
        value = (
            F.when(kind == "aadhaar", F.when((F.length(digits) == 12) & identifiers.verhoeff_valid(digits), digits))
            .when(kind == "pan", F.when(identifiers.shaped("PAN", compact), compact))
            .when(kind == "passport", F.when(size.between(6, 9) & F.rlike(compact, F.lit("[0-9]")), compact))
            .when(kind == "driving_license", F.when(F.rlike(compact, F.lit("^[A-Z]{2}[0-9]{9,17}$")), compact))
            .when(field == "document_number", F.when(size.between(4, 40) & ~F.rlike(compact, F.lit("^[0-9]{10,15}$")), compact))
            .when(field == "erp_id", F.when(size.between(3, 40) & F.rlike(compact, F.lit("[0-9]")), F.upper(body)))
            .otherwise(F.when(size.between(3, 40), F.upper(body)))
        )
        return F.when(~bad, value)

    split = lambda b: F.struct(b.alias("body"), F.upper(F.regexp_replace(b, "[^A-Za-z0-9]", "")).alias("compact"), F.regexp_replace(b, "[^0-9]", "").alias("digits"))
    return text.bound(F.regexp_replace(without_label(x), r"\s*([-/])\s*", "$1"), lambda b: text.bound(split(b), of))


def clean_gender(x: Column) -> Column:
    upper = F.upper(stripped(x))
    return F.when(F.rlike(upper, F.lit(r"\b(MALE|M)\b")), "MALE").when(F.rlike(upper, F.lit(r"\b(FEMALE|F)\b")), "FEMALE").when(F.rlike(upper, F.lit(r"\b(OTHER|O)\b")), "OTHER")


def clean_text(x: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(without_label(x), r"\s+", " "), r"^[ :#=|-]+|[ :#=|-]+$", "")
    return text.bound(body, lambda b: F.when((F.length(b) >= 2) & ~F.lower(b).isin("name", "number", "no", "id", "card", "address", "date", "valid", "none", "n/a"), b))


def cleaned(kind: Column, field: Column, family: Column, x: Column) -> Column:
    """A candidate as its kind of field has it, or null."""
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    upper = F.upper(stripped(x))
    return (
        F.when(kind == "name", clean_name(x)).when(kind == "relation", clean_relation(x)).when(kind == "surname", clean_name(x, 1))
        .when(kind == "date", clean_date(x)).when(kind == "identifier", clean_identifier(x, field, family)).when(kind == "address", clean_address(x))
        .when(kind == "year", first_match(x, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)).when(kind == "gender", clean_gender(x))
        .when(kind == "blood_group", F.regexp_replace(first_match(upper, r"\b(AB|A|B|O)\s*[+-]"), r"\s+", ""))
        .when(kind == "yes_no", F.when(F.rlike(upper, F.lit(r"\b(YES|Y)\b")), "YES").when(F.rlike(upper, F.lit(r"\b(NO|N)\b")), "NO"))
        .when(kind == "email", first_match(x, r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}")).when(kind == "phone", F.when(digits.between(7, 15), F.regexp_replace(stripped(x), r"\s+", "")))
        .when(kind == "postal_code", first_match(x, r"\b[0-9]{5,6}\b")).otherwise(clean_text(x))
    )


def lines_of(texts: DataFrame) -> DataFrame:
    """texts: doc_id, family, text. The lines that are not blank, with their labels, the segments between them, the next
    lines and whether those begin with a label."""
    rows = texts.select("doc_id", "family", F.posexplode(F.split(text.folded(F.coalesce(F.col("text"), F.lit(""))), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", text.squeezed(F.col("line"))).filter("line <> ''")
    rows = rows.withColumn("labels", F.regexp_extract_all("line", F.lit(LABEL), 1)).withColumn("segments", F.split("line", LABEL, -1))
    rows = rows.withColumn("begins", (F.size("labels") > 0) & ~F.rlike(F.get("segments", F.lit(0)), F.lit(r"[^\s:#=|-]")))
    page = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.withColumns({f"next{i}": F.lead("line", i).over(page) for i in range(1, AHEAD + 1)} | {f"stop{i}": F.lead("begins", i, True).over(page) for i in range(1, AHEAD + 1)})


def candidates(lines: DataFrame) -> DataFrame:
    """doc_id, family, field, kind, line_no, place (of the candidate among its label's), source, raw."""
    rows = lines.filter(F.size("labels") > 0).withColumn("row_mode", (F.size("labels") > 1) & F.forall(F.slice("segments", F.lit(2), F.size("labels")), lambda s: ~meaningful(s)))
    rows = rows.select("*", F.posexplode("labels").alias("k", "label"))
    rows = rows.withColumn("field", lookup(FIELD_OF, F.regexp_replace(F.lower("label"), "[^a-z]", ""))).withColumn("kind", lookup({f: k for f, (k, _) in FIELDS.items()}, F.col("field")))
    segment = F.get("segments", F.col("k") + 1)
    # An address holds words that are labels elsewhere ("DIST"): its line is cut at labels of other kinds alone.
    rest = F.regexp_replace(F.regexp_replace("line", r"(?i)^.*?\baddress\b", ""), AFTER_ADDRESS, "")
    raw = F.when(F.col("field") == "address", rest).otherwise(segment)
    alone = ~F.col("__same") & (F.col("k") == F.size("labels") - 1) & ~F.col("row_mode")
    cells = F.split("next1", r"\s*\|\s*|\t+")
    cell = F.when(F.size(cells) > 1, F.get(cells, F.least(F.col("k"), F.size(cells) - 1))).otherwise(F.col("next1"))
    rows = rows.withColumns({"__raw": raw, "__same": meaningful(raw), "__cell": cell}).withColumn("__alone", alone)

    def option(when: Column, place: int, source: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(place).alias("place"), F.lit(source).alias("source"), value.alias("raw")))

    found = [option(F.col("__same"), 0, "SAME_LINE", F.col("__raw")), option(F.col("row_mode") & ~F.col("stop1"), 0, "VALUE_ROW", F.col("__cell"))]
    opened = F.lit(True)
    following = []
    for i in range(1, AHEAD + 1):
        opened = opened & ~F.col(f"stop{i}")
        following.append(F.when(opened, F.col(f"next{i}")))
        if i < AHEAD:
            found.append(option(F.col("__alone") & opened & (F.col("field") != "address"), i, "NEXT_LINE", F.col(f"next{i}")))
    found.append(option(F.col("__alone") & (F.col("field") == "address") & ~F.col("stop1"), 0, "MULTI_LINE", F.concat_ws(", ", *following)))
    return rows.select("doc_id", "family", "field", "kind", "line_no", F.explode(F.array_compact(F.array(*found))).alias("__c")).select("doc_id", "family", "field", "kind", "line_no", "__c.*")


def chosen(found: DataFrame) -> DataFrame:
    """The best candidate of each document and field that has a value: by score, of addresses by length, then the first."""
    score = lookup({k: str(v) for k, v in SCORES.items()}, F.col("source")).cast("double") + F.when(F.col("field").isin("document_number", *NUMBERS), 3.0).otherwise(0.0)
    score = score + F.when(F.col("field") == "address", F.least(F.lit(5.0), F.length("value") / 40.0)).otherwise(0.0)
    rows = found.withColumn("score", F.bround(F.least(F.lit(99.0), score), 1))
    order = F.struct(-F.col("score"), F.when(F.col("field") == "address", -F.length("value")).otherwise(0), F.col("line_no"), F.col("place"), F.col("value"))
    # Candidates without a value have no order and are passed over; a filter before would clean each candidate twice.
    order = F.when(F.col("value").isNotNull(), order)
    return rows.groupBy("doc_id", "family", "field").agg(F.min_by(F.struct("value", "source", "score"), order).alias("__c")).filter("__c IS NOT NULL").select("doc_id", "family", "field", "__c.*")


def bare_numbers(texts: DataFrame) -> DataFrame:
    """Numbers that stand without a label, by the document's family."""
    upper = F.upper(F.coalesce(F.col("text"), F.lit("")))
    found = F.when(F.col("family") == "PAN", identifiers.find_pan(upper)).when(F.col("family") == "PASSPORT", identifiers.find_passport(upper)).when(F.col("family") == "DRIVING_LICENSE", identifiers.find_licence(upper)).when(F.col("family") == "COLLEGE_ID", identifiers.find_college_id(upper)).when(F.col("family") == "VISA", identifiers.find_visa(upper)).when(F.col("family") == "NATIONAL_ID", identifiers.find_labelled(upper))
    return texts.select("doc_id", "family", F.lit("document_number").alias("field"), found.alias("value"), F.lit("ANYWHERE").alias("source"), F.lit(70.0).alias("score")).filter("value IS NOT NULL")


def spread(texts: DataFrame) -> DataFrame:
    """Documents dealt over all partitions of a shuffle: their bytes are few for the work they make, so that by size a file of
    cards, and the shuffles after it, would be one task."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def extract(texts: DataFrame) -> DataFrame:
    """texts: doc_id, family (null: any), text. Long form: doc_id, field, value, source, score. Numbers of a family stand
    for document_number, and relation_name for father_name on the families that print it so, where those are missing."""
    texts = spread(texts.select("doc_id", F.coalesce(F.col("family"), F.lit("")).alias("family"), "text"))
    best = chosen(candidates(lines_of(texts)).withColumn("value", cleaned(F.col("kind"), F.col("field"), F.col("family"), F.col("raw"))))
    alias = F.when(F.col("field").isin(*NUMBERS), "document_number").when((F.col("field") == "relation_name") & F.col("family").isin("AADHAAR", "DRIVING_LICENSE"), "father_name")
    # Both names of a value in one pass: a union of two selections would find every candidate twice.
    named = F.array_compact(F.array(F.struct(F.col("field"), F.lit(0).alias("rank")), F.when(alias.isNotNull(), F.struct(alias.alias("field"), F.lit(1).alias("rank")))))
    best = best.select("doc_id", "family", "value", "source", "score", F.explode(named).alias("__n")).select("doc_id", "family", "value", "source", "score", "__n.*")
    ranked = [best, bare_numbers(texts).withColumn("rank", F.lit(2))]
    # A row of dates tells validities apart that stand under their labels, and a heading names an institution before any label
    # does; a machine-readable zone fills what is missing.
    row = bundles.licence_dates(texts).withColumn("rank", F.when(F.col("field") == "issue_date", 2).otherwise(-1))
    ranked += [row, bundles.institutions(texts).withColumn("rank", F.lit(-1)), bundles.machine_zones(texts).withColumn("rank", F.lit(3))]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    order = F.struct("rank", -F.col("score"), F.col("value"))
    return every.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "source", "score"), order).alias("__c")).select("doc_id", "field", "__c.*")


NAMES = ("name", "father_name", "mother_name", "relation_name")


def repaired(fields: DataFrame, texts: DataFrame, references: DataFrame, least: float = 0.62) -> DataFrame:
    """fields of extract(); references: doc_id, field, reference. A name similar to its reference becomes it; where no
    name was found, a run of the text's words that is (as many words as the reference has, or one less) stands for it."""
    wanted = references.filter(F.col("field").isin(*NAMES) & (F.trim("reference") != "")).select("doc_id", "field", "reference")
    # References are as many as documents: by the size of their file alone they would be broadcast, through the driver.
    wanted = wanted.hint("merge")
    known = fields.join(wanted, ["doc_id", "field"], "left")
    judged = similarity.with_ratio(known, text.match_text(F.col("value")), text.match_text(F.col("reference")), least)
    kept = judged.select("doc_id", "field", F.when(F.col("ratio") >= least, F.col("reference")).otherwise(F.col("value")).alias("value"), "source", "score")
    missing = wanted.filter("field = 'name'").join(fields.select("doc_id", "field").hint("merge"), ["doc_id", "field"], "left_anti")
    words = F.split(text.squeezed(F.col("line")), " ")
    width = F.size(F.split(text.squeezed(F.col("reference")), " "))
    runs = F.flatten(F.transform(F.array(width, width - 1), lambda n: F.transform(F.when((n > 0) & (F.size("words") >= n), F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("words", i, n), " "))))
    lines = texts.select("doc_id", F.posexplode(F.split(text.folded(F.coalesce(F.col("text"), F.lit(""))), "\n")).alias("line_no", "line")).join(missing.hint("merge"), "doc_id")
    spans = lines.withColumn("words", words).select("doc_id", "field", "reference", F.explode(runs).alias("value"))
    near = similarity.with_ratio(spans, text.match_text(F.col("value")), text.match_text(F.col("reference")), least).filter(F.col("ratio") >= least)
    return kept.unionByName(near.groupBy("doc_id", "field").agg(F.first("reference").alias("value")).select("doc_id", "field", "value", F.lit("REFERENCE").alias("source"), F.lit(75.0).alias("score")))
