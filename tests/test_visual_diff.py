"""Regions of change against flood fill, and the steps before them against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from credenza import queries
from credenza.operators import visual_diff as vd

SF = "/root/testdata/sf0.001"


def flood(mask):
    """Regions by flood fill over eight neighbours."""
    left = {(y, x) for y in range(mask.shape[0]) for x in range(mask.shape[1]) if mask[y, x]}
    out = []
    while left:
        queue, own = [left.pop()], []
        while queue:
            y, x = queue.pop()
            own.append((y, x))
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            queue += near
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("shape", [(1, 1), (1, 30), (30, 1), (40, 60)])
def test_regions_are_those_of_flood_fill(shape, share):
    rng = np.random.default_rng(int(share * 100) + shape[0])
    mask = rng.random(shape) < share
    assert sorted(vd.regions(mask)) == flood(mask)
    spiral = np.zeros((21, 21), dtype=bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = spiral[k + 2 : 21 - k, k] = True
    assert sorted(vd.regions(spiral)) == flood(spiral)


def plain_mask(a, b):
    h, w = a.shape

    def stretch(g):
        low, high = int(g.min()), int(g.max())
        return [[0 if low == high else int((int(v) - low) * 255 / (high - low) + 0.5) for v in row] for row in g]

    def mirror(i, n):
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    p, q = stretch(a), stretch(b)
    d = [[abs(p[y][x] - q[y][x]) for x in range(w)] for y in range(h)]
    k = [1, 4, 6, 4, 1]
    blur = [[(sum(k[i] * k[j] * d[mirror(y + i - 2, h)][mirror(x + j - 2, w)] for i in range(5) for j in range(5)) + 128) // 256 for x in range(w)] for y in range(h)]
    my, mx = int(h * 0.02), int(w * 0.02)
    inside = [(y, x) for y in range(my, h - my) for x in range(mx, w - mx)]
    limit = max(18.0, float(np.percentile([blur[y][x] for y, x in inside], 90)))
    on = {(y, x) for y, x in inside if blur[y][x] >= limit}
    square = lambda y, x: [(y + i, x + j) for i in range(-2, 3) for j in range(-2, 3) if 0 <= y + i < h and 0 <= x + j < w]
    every = [(y, x) for y in range(h) for x in range(w)]
    erode = lambda s: {p for p in every if all(q in s for q in square(*p))}
    dilate = lambda s: {p for p in every if any(q in s for q in square(*p))}
    return erode(dilate(dilate(erode(on))))


@pytest.mark.parametrize("shape", [(1, 1), (3, 4), (25, 33), (60, 52)])
def test_changes_are_the_plain_loops(shape):
    rng = np.random.default_rng(shape[0])
    a = rng.integers(0, 200, shape)
    b = a.copy()
    b[shape[0] // 3 : shape[0] // 2 + 6, shape[1] // 4 : shape[1] // 2 + 5] = 255
    got = vd.changed(a, b)
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(got), strict=True)} == plain_mask(a, b)
    assert not vd.changed(a, a).any()


def test_the_largest_stay():
    found = [(0, i, 1, 1, 100 + 10 * i) for i in range(30)]
    assert [r[4] for r in vd.largest(found)] == [100 + 10 * i for i in range(29, 9, -1)]
    assert vd.largest([(0, 0, 9, 9, 179)]) == []


def test_pairs(spark):
    rng = random.Random(3)
    base = bytes([0, 255]) + bytes(rng.randrange(60, 90) for _ in range(120 * 100 - 2))
    edited = bytearray(base)
    for y in range(40, 60):
        edited[100 * y + 20 : 100 * y + 60] = bytes([250]) * 40
    raster = lambda data, w=100, h=120: (w, h, 1, bytes(data))
    rows = [(1, raster(base), raster(edited)), (2, raster(base), raster(base)), (3, None, raster(base)), (4, raster(base), (None,) * 4), (5, raster(base), raster(edited[: 100 * 90], 100, 90)), (None, raster(b"\5", 1, 1), raster(b"\7", 1, 1))]
    kind = "struct<width int, height int, channels int, samples binary>"
    got = {r.doc_id: r for r in vd.compare(spark.createDataFrame(rows, f"doc_id int, reference {kind}, other {kind}")).collect()}
    assert len(got) == 6 and got[2].band == "LOW" and not got[2].regions and got[3].band is got[4].band is None
    (region,) = got[1].regions
    assert abs(region.x - 20) <= 3 and abs(region.y - 40) <= 3 and abs(region.width - 40) <= 6 and abs(region.height - 20) <= 6 and got[1].band == "MEDIUM"
    assert len(got[5].regions) == 1 and got[None].regions == []


def test_query(spark):
    rows = queries.queries()["visual_difference"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and {r.band for r in rows} <= {"LOW", "MEDIUM", "HIGH"}
    assert any(r.n_regions for r in rows) and all(not r.n_regions for r in rows if r.doc_id % 3 == 2)
