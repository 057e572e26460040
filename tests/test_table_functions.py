"""Table functions called in SQL, against plain versions."""

from __future__ import annotations

import random
import zlib

import pytest

from credenza.functions import table_functions
from credenza.sources import pages, rasters


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def test_label_matches(spark, sql):
    rng = random.Random(1)
    kinds = ["", "  ", "Name", " Label: ", "x" * 39, "v" * 40, "value " * 20]
    docs = {i: [rng.choice(kinds) for _ in range(rng.randrange(0, 40))] for i in range(30)}
    rows = [(i, k, line) for i, lines in docs.items() for k, line in enumerate(lines)] + [(99, 0, None)]
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, pos bigint, line string").repartition(4).createOrReplaceTempView("some_lines")
    got = {tuple(r) for r in sql("SELECT * FROM label_matches(TABLE(some_lines) PARTITION BY doc_id ORDER BY pos)").collect()}
    want = set()
    for i, lines in docs.items():
        for k, line in enumerate(lines):
            ahead = next((x.strip() for x in lines[k + 1 : k + 5] if x.strip()), "")
            if 1 <= len(line.strip()) <= 39 and len(ahead) >= 40:
                want.add((i, k, ahead))
    assert got == want and len(want) > 20


def test_ocr_tokens(spark, sql):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    rows = ["1\t1\t0\t0\t0\t0\t0\t0\t640\t480\t-1\t", "5\t1\t1\t1\t2\t3\t10\t20\t30\t12\t96.5\tNAME", "5\t1\t1\t1\t2\t4\t50\t20\t30\t12\t0\tx\r", "5\t1\t1\t1\t2\t5\t50\t20\t30\t12\t90\t ", "5\t1\tbroken"]
    tables = [(1, "\n".join([head, *rows])), (2, head), (3, None), (4, "no table"), (5, "")]
    spark.createDataFrame(tables, "doc_id bigint, body string").createOrReplaceTempView("readings")
    got = sql("SELECT doc_id, t.* FROM readings, LATERAL ocr_tokens(body) t ORDER BY word").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 2, 3, 10, 20, 30, 12, 96.5, "NAME"), (1, 1, 1, 2, 4, 50, 20, 30, 12, 0.0, "x")]


def pdf(objects: dict[int, bytes], packed: dict[int, bytes] | None = None) -> bytes:
    out = b"%PDF-1.7\n"
    for number, body in objects.items():
        out += b"%d 0 obj\n%b\nendobj\n" % (number, body)
    if packed:
        head, data = b"", b""
        for number, body in packed.items():
            head += b"%d %d " % (number, len(data))
            data += body + b" "
        body = zlib.compress(head + data)
        out += b"900 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream\nendobj\n" % (len(packed), len(head), len(body), body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def image(width, height, data, kind=b"/DCTDecode", more=b""):
    return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /Filter %b %b /Length %d >>\nstream\n%b\nendstream" % (width, height, kind, more, len(data), data)


RGB = bytes(range(256)) * (3 * 600 * 512 // 256)
FILE = pdf(
    {
        20: b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /A 31 0 R /B 30 0 R /C 32 0 R >> >> >>",
        10: b"<< /Type /Page /Parent 2 0 R >>",
        30: image(600, 700, b"\xff\xd8first endobj \xff\xd9"),
        31: image(400, 4000, b"\xff\xd8thin"),
        32: image(800, 900, b"\0\1\2", b"/JPXDecode"),
        33: image(512, 600, zlib.compress(RGB), b"/FlateDecode", b"/ColorSpace /DeviceRGB /BitsPerComponent 8"),
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        40: b"<< /Type /Pages /Kids [21 0 R 22 0 R 40 0 R] /Parent 2 0 R >>",
        41: b"<< /XObject << /I 33 0 R >> >>",
    },
    {2: b"<< /Type /Pages /Kids [10 0 R 20 0 R 40 0 R] /Resources 41 0 R /Count 4 >>", 21: b"<< /Type /Page /Resources << >> >>", 22: b"<< /Type /Page >>"},
)


def test_pages_in_order():
    got = list(pages.pages_of(FILE, most=9))
    assert [g[:3] for g in got] == [(1, 512, 600), (2, 600, 700), (3, 512, 600), (4, 512, 600)] and got[1][3] == b"\xff\xd8first endobj \xff\xd9"
    assert rasters.read(got[0][3]) == (512, 600, 3, RGB)
    assert [g[1] for g in pages.pages_of(FILE, least_detail=1400)] == [None, None, None]
    filtered = rasters.write_png(512, 600, 3, RGB)
    at = filtered.index(b"IDAT")
    body = filtered[at + 4 : at + 4 + int.from_bytes(filtered[at - 4 : at], "big")]
    again = pdf({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Resources<</XObject<</I 4 0 R>>>>>>", 4: image(512, 600, body, b"/FlateDecode", b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /DecodeParms << /Predictor 15 /Colors 3 /Columns 512 >>")})
    assert rasters.read(next(pages.pages_of(again))[3])[3] == RGB


def test_pdf_pages_in_sql(spark, sql):
    spark.createDataFrame([(1, FILE), (2, None), (3, b"no pdf"), (4, FILE[: len(FILE) // 2])], "id bigint, content binary").createOrReplaceTempView("pdf_files")
    got = {(r.id, r.page): (r.width, r.height) for r in sql("SELECT id, p.* FROM pdf_files, LATERAL pdf_pages(content, false) p").collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): (512, 600), (1, 2): (600, 700), (1, 3): (512, 600)}
    assert not [k for k in got if k[0] in (2, 3)]
