"""Field extraction on the layouts that cards have."""

from __future__ import annotations

import pytest

from credenza.operators import extraction

CARDS = {
    1: ("", "Name | DOB | Gender\nTarun Velane | 17/11/1998 | Male", {"name": "Tarun Velane", "dob": "17/11/1998", "gender": "MALE"}),
    2: ("", "Name\nTarun Velane\nAddress\nMirapur PO Mirapur DIST Mirapur\nNorth Province 481205", {"name": "Tarun Velane", "address": "Mirapur PO Mirapur DIST Mirapur, North Province 481205"}),
    3: ("PAN", "Permanent Account Number Card\nPAN No: QWRPV5820K\nName: Tarun Velane", {"pan_number": "QWRPV5820K", "document_number": "QWRPV5820K", "name": "Tarun Velane"}),
    4: ("PAN", "Permanent Account Number Card\nQWRPV5820K\nName\nValid unless Physically Signed\nTARUN VELANE\nFather's Name\ngle u onf\nMOHIT RAVI VELANE\nDate of Birth\n17/11/1998", {"name": "TARUN VELANE", "father_name": "MOHIT RAVI VELANE", "document_number": "QWRPV5820K", "dob": "17/11/1998"}),
    5: ("AADHAAR", "Government of India\nMirapur PO Mirapur DIST Mirapur\nDOB: 17/11/1998\nGender: Male\nAadhaar No: 582036172943", {"name": None, "dob": "17/11/1998", "gender": "MALE", "document_number": "582036172943"}),
    6: ("AADHAAR", "Name\nTarun Velane\nDOB: 17/11/1998\nFather: Mohit Ravi Velane\nAddress: Mirapur PO Mirapur DIST Mirapur\nAadhaar No: 582036172943", {"name": "Tarun Velane", "father_name": "Mohit Ravi Velane", "address": "Mirapur PO Mirapur DIST Mirapur"}),
    7: ("AADHAAR", "Aadhaar No: 582036172944\nDOB: 17/11/1998\nGender: Male", {"document_number": None}),
    8: ("PAN", "Permanent Account Number Card\nName\nTARUN VELANE", {"document_number": None, "name": "TARUN VELANE"}),
    9: ("COLLEGE_ID", "Student Name\nNILO SEREVIN\nRoll No\nME24EE117\nCourse\nBTECH (CSE)", {"name": "NILO SEREVIN", "document_number": "ME24EE117", "course": "BTECH (CSE)"}),
    10: ("AADHAAR", "S/O OSMIN TAL BERUN 15 MIRAPUR", {"relation_name": "OSMIN TAL BERUN", "father_name": "OSMIN TAL BERUN"}),
    11: ("", "Name: KEVAL ORDINE xqelo rimtu\nBlood Group: ab +\nEmail: a.b@c.org\nMobile No: +91 98765 43210\nPin Code 481205\nOrgan Donor: Y", {"name": "KEVAL ORDINE", "blood_group": "AB+", "email": "a.b@c.org", "phone": "+919876543210", "pincode": "481205", "organ_donor": "YES"}),
    12: ("DRIVING_LICENSE", "DL No: UP34 20190047715\nDate of Issue: 31-02-2021\nValid Till: 12 March 2031", {"document_number": "UP3420190047715", "issue_date": "31-02-2021", "expiry_date": "12 March 2031"}),
    13: ("PASSPORT", "Passport\nU1234568\nSurname: VELANE", {"document_number": "U1234568", "surname": "VELANE"}),
    17: ("VISA", "Entry Permit\nVisa No: AB123456", {"document_number": "AB123456", "visa_number": "AB123456"}),
    18: ("NATIONAL_ID", "Identity Number 4321-AB\nCard No 1234567890123456", {"document_number": "4321AB"}),
    # A name of one letter's word is noise, an address on its label's line ends there, a bare "Number" is no label.
    19: ("", "Name: Jane Q Public\nDOB\n15.08.1990\nAddress: 1 High St\nOld Town\nGender: F\nNumber: ab-12 34", {"name": None, "dob": "15/08/1990", "address": "1 High St", "gender": "FEMALE", "document_number": None}),
    14: ("", "Address: Please provide your address", {"address": None}),
    15: ("PAN", None, {"name": None}),
    16: ("PAN", "", {"name": None}),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, family, text) for i, (family, text, _) in CARDS.items()], "doc_id bigint, family string, text string").repartition(3)


def test_cards(texts):
    got = {(r.doc_id, r.field): r.value for r in extraction.extract(texts).collect()}
    assert {(i, f): got.get((i, f)) for i, (_, _, want) in CARDS.items() for f in want} == {(i, f): v for i, (_, _, want) in CARDS.items() for f, v in want.items()}


def test_references_repair_names(spark, texts):
    noisy = spark.createDataFrame([(20, "DRIVING_LICENSE", "KEVAL ORDINE xqelo rimtu\n28-01-2002\nDL No: UP3420190047715")], texts.schema)
    whole = texts.unionByName(noisy)
    references = spark.createDataFrame([(4, "name", "Tarun Velane"), (20, "name", "Keval Ordine"), (9, "name", "Someone Else"), (5, "name", "Tarun Velane")], "doc_id bigint, field string, reference string")
    got = {(r.doc_id, r.field): r.value for r in extraction.repaired(extraction.extract(whole), whole, references).collect()}
    assert got[4, "name"] == "Tarun Velane" and got[20, "name"] == "Keval Ordine" and got[9, "name"] == "NILO SEREVIN" and (5, "name") not in got
    assert got[4, "father_name"] == "MOHIT RAVI VELANE"


def test_each_label_names_its_field():
    assert len(extraction.FIELD_OF) > 100 and extraction.FIELD_OF["dateofbirth"] == extraction.FIELD_OF["dob"] == "dob"


def test_codes_are_six_digits_and_repeatable(spark):
    from credenza.functions import text

    df = spark.range(50)
    codes = [r[0] for r in df.select(text.one_time_code(3)).collect()]
    assert all(len(c) == 6 and c.isdigit() for c in codes) and codes == [r[0] for r in df.select(text.one_time_code(3)).collect()] and len(set(codes)) > 40
    assert len({r[0] for r in df.select(text.case_id()).collect()}) == 50
