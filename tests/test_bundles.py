"""Zones, rows of dates and headings in their odd cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from credenza.functions import identifiers
from credenza.operators import bundles

SCHEMA = "doc_id bigint, family string, text string"
SECOND = "Z1234567<4IND9803121F3103121<<<<<<<<<<<<<<04"


def found(df):
    return {(r.doc_id, r.field): r.value for r in df.collect()}


def test_machine_zones(spark):
    rows = [
        (1, "PASSPORT", f"x\n p<ind velane << tarun < ravi<<<\n{SECOND}"), (2, "", f"P<INDVELANE<<\r\n{SECOND.replace('F', '<', 1)}"), (3, "", f"P<INDA<<B\n{SECOND[:39]}\n"),
        (4, "", f"P<INDOLD<<ONE\nshort<\nP<INDNEW<<TWO\n{SECOND}"), (5, "", None), (6, "", ""), (7, "", "P<IND only"), (8, "", f"P<INDA<<B\n{SECOND.replace('980312', '981332').replace('Z1234567', '12<<4567')}"),
    ]
    got = found(bundles.machine_zones(spark.createDataFrame(rows, SCHEMA)))
    assert {f: v for (i, f), v in got.items() if i == 1} == {"document_number": "Z1234567", "nationality": "IND", "dob": "1998-03-12", "gender": "FEMALE", "expiry_date": "12-03-2031", "surname": "VELANE", "given_names": "TARUN RAVI", "name": "TARUN RAVI VELANE"}
    assert got[2, "gender"] == "UNSPECIFIED" and got[2, "name"] == "VELANE" and (2, "given_names") not in got
    assert got[4, "surname"] == "NEW" and not [k for k in got if k[0] in (3, 5, 6, 7)]
    assert (8, "dob") not in got and (8, "document_number") not in got and got[8, "expiry_date"] == "12-03-2031"


def test_licence_dates(spark):
    rows = [(1, "DRIVING_LICENSE", "Issue Date Validity\n01-02-2020"), (2, "DRIVING_LICENSE", "Issue Date: 1/2/20 Validity (NT) 3/4/2040 x 5-6-25\nnext"), (3, "PAN", "Issue Date Validity\n01-02-2020 01-02-2040"), (4, "DRIVING_LICENSE", "Validity\n01-02-2020"), (5, "DRIVING_LICENSE", None)]
    assert found(bundles.licence_dates(spark.createDataFrame(rows, SCHEMA))) == {(1, "issue_date"): "01-02-2020", (2, "issue_date"): "1/2/20", (2, "validity_nt"): "3/4/2040", (2, "validity_tr"): "5-6-25"}


def test_institutions(spark):
    rows = [(1, "COLLEGE_ID", "Card\n|| 0 % Lakeside  College of la Design\nInstitute of Arts\nName: x"), (2, "COLLEGE_ID", "college of\nHill University College"), (3, "COLLEGE_ID", "Faculty of Engineering & Care\nName: College"), (4, "VISA", "Lakeside College"), (5, "COLLEGE_ID", ""), (6, "COLLEGE_ID", "no such")]
    assert found(bundles.institutions(spark.createDataFrame(rows, SCHEMA))) == {(1, "institution_name"): "Lakeside College of Design Institute of Arts", (2, "institution_name"): "college of Hill University College", (3, "institution_name"): "Faculty of Engineering & Care"}


def test_windowed_numbers(spark):
    rows = [(1, "xx AB0DE l234F"), (2, "4BCDEI23AF"), (3, "abcde-1234-f zz QWERT1234P"), (4, "ABCDE12345"), (5, None), (6, "short"), (7, "8BCDE0O0Q8"), (8, "ABCDED2345")]
    df = spark.createDataFrame(rows, "doc_id int, raw string").select("doc_id", identifiers.windowed_pan(F.col("raw")).alias("n"))
    letters, digits = str.maketrans("012568", "OIZSGB"), str.maketrans("OQDILZSB", "00011258")

    def plain(raw):
        x = re.sub("[^A-Z0-9]", "", (raw or "").upper())
        fixed = (w[:5].translate(letters) + w[5:9].translate(digits) + w[9:].translate(letters) for w in (x[i : i + 10] for i in range(len(x) - 9)))
        return next((w for w in fixed if re.fullmatch("[A-Z]{5}[0-9]{4}[A-Z]", w)), None)

    got = {r.doc_id: r.n for r in df.collect()}
    assert got == {i: plain(raw) for i, raw in rows} and got[3] == "ABCDE1234F" and got[7] == "BBCDE0000B" and got[4] == "ABCDE1234S"
