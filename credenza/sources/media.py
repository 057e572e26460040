"""Readers of what stands beside the pixels: EXIF tags of JPEG files, images embedded in PDF files, token tables.

Files come as binary columns (see uploads.py), one row a file, and are read in Arrow batches; nothing is decoded here.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of the text tags that rules read, and limits on embedded images.
TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized"}
#: Fixed value: the tag that leads to the camera's own directory.
CAMERA = 0x8769
LEAST_SIDE, MOST_PAGES = 500, 3
LEAST_CONFIDENCE = 28.0


def exif_block(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG or PNG file, or a TIFF file itself."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def text_tags(block: bytes) -> dict[str, str]:
    """Text tags of the block's first directory and of the camera's; what doesn't lie in the block is left out."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return {}
    out: dict[str, str] = {}
    waiting, seen = [struct.unpack_from(order + "I", block, 4)[0]], set()
    while waiting:
        start = waiting.pop()
        if start in seen or start + 2 > len(block):
            continue
        seen.add(start)
        for i in range(struct.unpack_from(order + "H", block, start)[0]):
            entry = start + 2 + 12 * i
            if entry + 12 > len(block):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", block, entry)
            place = struct.unpack_from(order + "I", block, entry + 8)[0]
            if tag == CAMERA and kind == 4:
                waiting.append(place)
            elif kind == 2 and tag in TAGS:
                place = entry + 8 if n <= 4 else place
                value = block[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()
                if place + n <= len(block) and value:
                    out.setdefault(TAGS[tag], value)
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def exif_tags(content: pd.Series) -> pd.Series:
    """Text tags by name; empty for files that have none, and for files of other formats than JPEG, PNG and TIFF."""
    return content.map(lambda c: text_tags(exif_block(bytes(c)) or b"") if c is not None else {})


OBJECT = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n")


def embedded_images(content: bytes) -> list[tuple[int, int, bytes]]:
    """Width, height and bytes of the JPEG images of a PDF file, in order."""
    out = []
    for found in OBJECT.finditer(content):
        body = found[1]
        numbers = {k: re.search(rb"/" + k + rb"\s+(\d+)(?!\s+\d+\s+R)", body) for k in (b"Width", b"Height", b"Length")}
        if not (re.search(rb"/Subtype\s*/Image", body) and b"/DCTDecode" in body and numbers[b"Width"] and numbers[b"Height"]):
            continue
        end = found.end() + int(numbers[b"Length"][1]) if numbers[b"Length"] else content.find(b"endstream", found.end())
        out.append((int(numbers[b"Width"][1]), int(numbers[b"Height"][1]), content[found.end() : end]))
    return out


def pdf_images(files: DataFrame, most: int = MOST_PAGES, least_side: int = LEAST_SIDE) -> DataFrame:
    """files: path, content. The largest embedded images of each file (path, rank, width, height, image), `most` of
    them, both sides at least `least_side`; a file without any has no rows."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("rank", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("image", pa.binary())])
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [x for x in embedded_images(content or b"") if min(x[0], x[1]) >= least_side]
                rows += [(path, i, *x) for i, x in enumerate(sorted(found, key=lambda x: -x[0] * x[1])[:most], 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, rank int, width int, height int, image binary")


def token_scan(tokens: DataFrame) -> DataFrame:
    """Words that a reader gives with a confidence (-1 marks layout rows), and are not blank."""
    return tokens.filter((F.col("conf") >= 0) & (F.trim("text") != ""))


def multi_variant(tokens: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Words of all variants and page modes of an image that are read with at least this confidence."""
    return token_scan(tokens).filter(F.col("conf") >= least)


def boxes(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Boxes of the first reader; of documents for which it has none, the second's, whose confidence is in percent."""
    second = fallback.join(primary.select("doc_id").distinct(), "doc_id", "left_anti")
    return primary.unionByName(second.withColumn("conf", F.col("conf") / 100))
