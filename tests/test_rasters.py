"""Rasters: files written and read back, kernels against plain loops."""

from __future__ import annotations

import math
import random
import statistics
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from credenza import queries
from credenza.operators import kernels
from credenza.plans import rules
from credenza.sources import rasters

SF = "/root/testdata/sf0.001"


def image(seed, height, width, channels):
    """Smooth ramps, sharp rectangles, bright pale places and noise."""
    rng = random.Random(seed)
    out = [[[(7 * y + 3 * x + 40 * c) % 256 for c in range(channels)] for x in range(width)] for y in range(height)]
    for _ in range(4):
        y0, x0, v = rng.randrange(height), rng.randrange(width), rng.choice((0, 250, 255, 130))
        for y in range(y0, min(height, y0 + rng.randrange(1, 12))):
            for x in range(x0, min(width, x0 + rng.randrange(1, 20))):
                out[y][x] = [max(0, v - rng.randrange(4)) for _ in range(channels)]
    return out


def flat(pixels):
    return bytes(v for row in pixels for p in row for v in p)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (13, 1), (11, 17)])
def test_png_round_trip(channels, shape):
    samples = flat(image(channels, *shape, channels))
    for filters in ((0, 1, 2, 3, 4), (4,), (3,)):
        content = rasters.write_png(shape[1], shape[0], channels, samples, filters)
        assert rasters.read(content) == (shape[1], shape[0], channels, samples)


def test_png_of_few_bits_and_palettes():
    def png(width, height, depth, colour, rows, extra=b""):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    assert rasters.read(png(5, 2, 1, 0, [b"\xa8", b"\x50"])) == (5, 2, 1, bytes([255, 0, 255, 0, 255, 0, 255, 0, 255, 0]))
    assert rasters.read(png(3, 1, 4, 0, [b"\x1f\x80"])) == (3, 1, 1, bytes([17, 255, 136]))
    palette = chunk(b"PLTE", bytes(range(12)))
    assert rasters.read(png(4, 1, 2, 3, [b"\x1b"], palette)) == (4, 1, 3, bytes(range(12)))
    assert rasters.read(png(1, 1, 8, 3, [b"\x04"], palette)) is None and rasters.read(png(1, 1, 8, 3, [b"\x01"])) is None
    assert rasters.read(png(2, 1, 16, 2, [bytes(range(12))])) == (2, 1, 3, bytes([0, 2, 4, 6, 8, 10]))


def test_bmp_round_trip():
    for shape in ((1, 1), (5, 7), (4, 8)):
        samples = flat(image(5, *shape, 3))
        content = rasters.write_bmp(shape[1], shape[0], 3, samples)
        assert rasters.read(content) == (shape[1], shape[0], 3, samples)
        turned = content[:22] + struct.pack("<i", -shape[0]) + content[26:]
        rows = [samples[i : i + 3 * shape[1]] for i in range(0, len(samples), 3 * shape[1])]
        assert rasters.read(turned) == (shape[1], shape[0], 3, b"".join(rows[::-1]))


def test_broken_files(spark):
    good = rasters.write_png(3, 2, 1, bytes(range(6)))
    files = [None, b"", b"BM", b"\xff\xd8jpeg", good[:-20], good[:40], good[:45] + b"x" + good[46:], rasters.PNG, rasters.write_bmp(4, 4, 3, bytes(48))[:-1], good + b"tail", good]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id bigint, content binary")
    got = {r.doc_id: r for r in rasters.read_rasters(df).collect()}
    assert len(got) == len(files) and {i for i, r in got.items() if r.width} == {9, 10} and bytes(got[10].samples) == bytes(range(6))
    assert rasters.read_rasters(df.limit(0)).collect() == [] and rasters.read_rasters(df, most=5).filter("width IS NOT NULL").count() == 0
    quality = {r.doc_id: r for r in kernels.quality(rasters.read_rasters(df)).collect()}
    assert quality[0].brightness is None and quality[9].brightness == 2.5 and len(quality) == len(files)
    assert {r.doc_id for r in kernels.blocks(rasters.read_rasters(df)).collect()} == {9, 10}


def grey(p):
    return p[0] if len(p) < 3 else (4899 * p[0] + 9617 * p[1] + 1868 * p[2] + 8192) >> 14


def at(g, y, x, y0=0, y1=None, x0=0, x1=None):
    """The value at a place, mirrored at the edges of its part."""
    y1, x1 = len(g) if y1 is None else y1, len(g[0]) if x1 is None else x1
    y = y0 + abs(y - y0) if y1 - y0 > 1 else y0
    x = x0 + abs(x - x0) if x1 - x0 > 1 else x0
    y = y if y < y1 else 2 * (y1 - 1) - y
    x = x if x < x1 else 2 * (x1 - 1) - x
    return g[y][x]


def plain_edges(g):
    h, w = len(g), len(g[0])
    grad = {}
    for y in range(h):
        for x in range(w):
            v = {(dy, dx): at(g, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
            gx = v[-1, 1] + 2 * v[0, 1] + v[1, 1] - v[-1, -1] - 2 * v[0, -1] - v[1, -1]
            gy = v[1, -1] + 2 * v[1, 0] + v[1, 1] - v[-1, -1] - 2 * v[-1, 0] - v[-1, 1]
            grad[y, x] = gx, gy
    size = lambda y, x: sum(map(abs, grad[y, x])) if (y, x) in grad else 0
    weak = set()
    for (y, x), (gx, gy) in grad.items():
        m = size(y, x)
        if m <= 60:
            continue
        if abs(gy) * 32768 < 13573 * abs(gx):
            ok = m > size(y, x - 1) and m >= size(y, x + 1)
        elif abs(gy) * 32768 > 13573 * abs(gx) + abs(gx) * 65536:
            ok = m > size(y - 1, x) and m >= size(y + 1, x)
        else:
            s = 1 if (gx < 0) == (gy < 0) else -1
            ok = m > size(y - 1, x - s) and m > size(y + 1, x + s)
        if ok:
            weak.add((y, x))
    found = {p for p in weak if size(*p) > 160}
    queue = list(found)
    while queue:
        y, x = queue.pop()
        for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if q in weak and q not in found:
                found.add(q)
                queue.append(q)
    return found


def plain_quality(pixels):
    h, w = len(pixels), len(pixels[0])
    g = [[grey(p) for p in row] for row in pixels]
    every = [v for row in g for v in row]
    lap = [at(g, y - 1, x) + at(g, y + 1, x) + at(g, y, x - 1) + at(g, y, x + 1) - 4 * g[y][x] for y in range(h) for x in range(w)]
    glare = 0
    for row in pixels:
        for p in row:
            c = p[:3] if len(p) >= 3 else [p[0]] * 3
            saturation = math.floor(255 * (max(c) - min(c)) / max(c) + 0.5) if max(c) else 0
            glare += saturation < 35 and max(c) > 245
    found = plain_edges(g)
    skew, most = 0.0, max(80, min(h, w) // 5) - 1
    for degrees in sorted(range(-15, 16), key=lambda d: (abs(d), d)):
        votes = Counter(math.floor(y * np.cos(np.radians(degrees)) - x * np.sin(np.radians(degrees)) + 0.5) for y, x in found)
        if max(votes.values(), default=0) > most:
            skew, most = float(degrees), max(votes.values())
    return w, h, statistics.fmean(every), statistics.pstdev(every), statistics.pvariance(lap), skew, glare / (h * w), len(found) / (h * w)


@pytest.mark.parametrize("shape", [(1, 1), (1, 6), (9, 1), (24, 31), (40, 16)])
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_quality_is_the_plain_loops(shape, channels):
    pixels = image(shape[0] + channels, *shape, channels)
    got = kernels.quality_of(np.array(pixels, dtype=np.uint8))
    assert got == pytest.approx(plain_quality(pixels), rel=1e-9, abs=1e-9)


def test_skew_of_a_tilted_line():
    pixels = np.full((120, 200, 1), 255, dtype=np.uint8)
    for x in range(200):
        y = 40 + round(x * math.tan(math.radians(5)))
        pixels[y : y + 6, x] = 0
    assert kernels.quality_of(pixels)[5] == 5.0 and kernels.quality_of(pixels[::-1])[5] == -5.0 and kernels.quality_of(pixels)[7] > 0


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (24, 31), (16, 8)])
def test_blocks_are_the_plain_loops(shape):
    pixels = image(9, *shape, 3)
    g = [[grey(p) for p in row] for row in pixels]
    want = []
    for r in range(8):
        for c in range(8):
            y0, y1, x0, x1 = r * shape[0] // 8, (r + 1) * shape[0] // 8, c * shape[1] // 8, (c + 1) * shape[1] // 8
            if y1 > y0 and x1 > x0:
                own = lambda y, x: at(g, y, x, y0, y1, x0, x1)  # noqa: B023, E731
                places = [(y, x) for y in range(y0, y1) for x in range(x0, x1)]
                v = [g[y][x] for y, x in places]
                lap = [own(y - 1, x) + own(y + 1, x) + own(y, x - 1) + own(y, x + 1) - 4 * g[y][x] for y, x in places]
                blur = [(sum((2 - abs(dy)) * (2 - abs(dx)) * own(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + 8) >> 4 for y, x in places]
                noise = [max(0, a - b) for a, b in zip(v, blur, strict=True)]
                want.append((r, c, len(v), statistics.fmean(v), statistics.pvariance(v), math.log1p(statistics.pvariance(lap)), statistics.pvariance(noise)))
    got = kernels.blocks_of(np.array(pixels, dtype=np.uint8))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_texture_statistics(spark):
    files = spark.createDataFrame([(i, rasters.write_png(33, 40, 1, flat(image(i, 40, 33, 1)))) for i in range(6)], "doc_id bigint, content binary")
    of_blocks = kernels.blocks(rasters.read_rasters(files))
    got = {r.doc_id: tuple(r)[1:] for r in kernels.texture(of_blocks).collect()}
    for i in range(6):
        rows = kernels.blocks_of(np.array(image(i, 40, 33, 1), dtype=np.uint8))
        t, n = [r[5] for r in rows], [r[6] for r in rows]
        middle = statistics.median(t)
        scale = max(1.4826 * statistics.median([abs(x - middle) for x in t]), 0.12)
        want = (statistics.pstdev(t) / max(statistics.fmean(map(abs, t)), 0.1), statistics.pstdev(n) / max(statistics.fmean(map(abs, n)), 0.1), sum(abs(x - middle) / scale >= 3.5 for x in t) / len(t))
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_queries_feed_the_rules(spark):
    """Every document has a quality and a level, and those of its own raster."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bands = {r.doc_id: r for r in queries.queries()["raster_quality"](spark, SF).collect()}
    levels = {r.doc_id: r for r in queries.queries()["raster_texture"](spark, SF).collect()}
    assert bands.keys() == levels.keys() == docs.keys()
    for doc in list(docs)[:40]:
        height = max(1, -(-len(docs[doc]) // 64))
        raw = docs[doc].ljust(64 * height)
        pixels = [[[raw[64 * y + x]] for x in range(64)] for y in range(height)]
        want = plain_quality(pixels)
        assert tuple(bands[doc])[1:9] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert bands[doc].overall in ("GOOD", "MODERATE", "POOR") and levels[doc].integrity_status
    assert set(rules.quality_bands()) <= set(bands[doc].asDict())
