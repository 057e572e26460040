"""Readers of files, on files made here."""

from __future__ import annotations

import struct
from datetime import datetime

from pyspark.sql import functions as F

from credenza.sources import media, rasters, uploads


def jpeg(tags: dict[int, bytes], order: str = "<") -> bytes:
    """A JPEG head with these text tags."""
    entries, extra, base = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, value in tags.items():
        value += b"\0"
        place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", base + len(extra))
        extra += value if len(value) > 4 else b""
        entries += struct.pack(order + "HHI", tag, 2, len(value)) + place
    block = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + extra
    segment = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xda"


def test_exif_tags(spark):
    whole = jpeg({0x010F: b"Canon", 0x0131: b"Some Editor 1", 0x0100: b"skip", 0x013B: b"Me"})
    files = [(1, whole), (2, jpeg({0x0110: b"EOS"}, ">")), (3, b"\xff\xd8\xff\xda"), (4, b"not a jpeg"), (5, None), (6, whole[:40]), (7, b"")]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in files], "n int, content binary")
    got = {r.n: r.tags for r in df.select("n", media.exif_tags("content").alias("tags")).collect()}
    assert got == {1: {"Make": "Canon", "Software": "Some Editor 1", "Artist": "Me"}, 2: {"Model": "EOS"}, 3: {}, 4: {}, 5: {}, 6: {}, 7: {}}


def pdf(*images: tuple[int, int, bytes]) -> bytes:
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n"
    for i, (w, h, body) in enumerate(images):
        out += b"%d 0 obj << /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace << /N 3 >> /Filter /DCTDecode /Length %d >> stream\n" % (i + 2, w, h, len(body)) + body + b"\nendstream endobj\n"
    return out + b"9 0 obj << /Length 3 >> stream\nabc\nendstream endobj"


def test_pdf_images(spark):
    content = pdf((400, 900, b"small"), (600, 700, b"\xff\xd8 endstream first"), (1600, 1200, b"large"), (800, 800, b"x"), (900, 900, b"y"))
    df = spark.createDataFrame([("a.pdf", bytearray(content)), ("b.pdf", bytearray(b"%PDF")), ("c.pdf", None)], "path string, content binary")
    assert [(r.path, r.rank, r.width, bytes(r.image)) for r in media.pdf_images(df).orderBy("rank").collect()] == [("a.pdf", 1, 1600, b"large"), ("a.pdf", 2, 900, b"y"), ("a.pdf", 3, 800, b"x")]


def test_tokens_and_boxes(spark):
    tokens = spark.createDataFrame([(1, "a", 90.0), (1, " ", 90.0), (1, "b", -1.0), (1, "c", 10.0)], "doc_id int, text string, conf double")
    assert [r.text for r in media.token_scan(tokens).collect()] == ["a", "c"] and [r.text for r in media.multi_variant(tokens).collect()] == ["a"]
    other = tokens.withColumn("doc_id", F.lit(2)).filter("text = 'a'").unionByName(tokens.limit(1))
    assert sorted((r.doc_id, r.text, r.conf) for r in media.boxes(tokens.filter("text = 'c'"), other).collect()) == [(1, "c", 10.0), (2, "a", 0.9)]


def test_uploads(spark, tmp_path):
    for name, body in (("one.JPG", b"x" * 10), ("two.pdf", b"y"), ("three.exe", b"z"), ("empty.png", b"")):
        (tmp_path / name).write_bytes(body)
    got = uploads.uploads(spark, f"file://{tmp_path}").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["one.JPG", "two.pdf"]


def test_newest_named(spark):
    at = lambda d: datetime(2024, 1, d)
    files = spark.createDataFrame([("f/1_u.jpg", at(1)), ("f/2_u.jpg", at(3)), ("g/u.jpg", at(2)), ("f/xu.jpg", at(5))], "path string, modificationTime timestamp")
    assert uploads.newest_named(files, "u.jpg").first().path == "f/2_u.jpg" and uploads.newest_named(files, "none").first().path is None


def test_bodies(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{bad",), (None,)], "j string")
    assert [r.b.b if r.b else None for r in df.select(uploads.body(F.col("j"), "a int, b string").alias("b")).collect()] == ["x", None, None]


def test_exif_of_other_files_and_of_the_camera():
    """The camera's own directory, big and little ends, in PNG and TIFF files; pointers in a circle end."""
    for order, head in (("<", b"II*\0"), (">", b"MM\0*")):
        text, day = b"Maker\0", b"2021:03:04 05:06:07\0"
        first = struct.pack(order + "HHHIIHHII", 2, 0x010F, 2, len(text), 62, 0x8769, 4, 1, 38)
        camera = struct.pack(order + "HHHII", 1, 0x9003, 2, len(day), 68) + struct.pack(order + "I", 0)
        block = (head + struct.pack(order + "I", 8) + first + struct.pack(order + "I", 0)).ljust(38, b"\0") + camera
        block = block.ljust(62, b"\0") + text + day
        assert media.text_tags(block) == {"Make": "Maker", "DateTimeOriginal": "2021:03:04 05:06:07"}
        png = rasters.write_png(1, 1, 1, b"\0")
        assert media.exif_block(block) == block and media.exif_block(png[:33] + struct.pack(">I", len(block)) + b"eXIf" + block + b"crc!" + png[33:]) == block and media.exif_block(png) is None
        circle = block.replace(struct.pack(order + "HHII", 0x8769, 4, 1, 38), struct.pack(order + "HHII", 0x8769, 4, 1, 8))
        assert media.text_tags(circle) == {"Make": "Maker"}
