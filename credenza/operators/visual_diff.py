"""Visual difference of two rasters: what changed, as connected regions with boxes and areas, a score and a band.

Pairs of rasters come as rows; one pair is in memory at a time. Regions are labelled by union-find over the runs of changed places in
each row, so that the work follows the runs and not the places.

Alignment by matched features is not done here: rasters of unequal size are compared where both have places, from the upper left.

Defined cases: a null raster, or a pair without a common place, has null results and no regions; equal rasters have none either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.operators import kernels

#: Margin that is left out (a share of the side), least threshold and the percentile it follows, side of the
#: opening's square, weights of the blur, most regions and least area, points of the score and its bands.
MARGIN, LEAST_CHANGE, PERCENTILE, SQUARE, BLUR = 0.02, 18.0, 90, 5, (1, 4, 6, 4, 1)
MOST_REGIONS, LEAST_AREA = 20, 180
SHARE_POINTS, REGION_POINTS, HIGH, MEDIUM = 280.0, 1.8, 55, 18


def stretched(grey: np.ndarray) -> np.ndarray:
    """Values spread from 0 to 255."""
    low, high = int(grey.min()), int(grey.max())
    return np.zeros_like(grey) if low == high else (2 * 255 * (grey - low) + (high - low)) // (2 * (high - low))


def mirrored_at(n: int, by: int) -> np.ndarray:
    """Places 0 to n-1 moved by so many, mirrored at the ends."""
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    place = np.abs(np.arange(n) + by) % (2 * (n - 1))
    return np.where(place >= n, 2 * (n - 1) - place, place)


def blurred(x: np.ndarray) -> np.ndarray:
    middle = len(BLUR) // 2
    down = sum(w * x[mirrored_at(x.shape[0], k - middle)] for k, w in enumerate(BLUR))
    across = sum(w * down[:, mirrored_at(x.shape[1], k - middle)] for k, w in enumerate(BLUR))
    return (across + sum(BLUR) ** 2 // 2) // sum(BLUR) ** 2


def spread(mask: np.ndarray, side: int, grow: bool) -> np.ndarray:
    """Dilation by a square, or erosion (places outside neither grow nor shrink)."""
    half = side // 2
    for axis in (0, 1):
        wide = np.pad(mask, [(half, half) if a == axis else (0, 0) for a in (0, 1)], constant_values=not grow)
        views = np.lib.stride_tricks.sliding_window_view(wide, side, axis=axis)
        mask = views.any(axis=-1) if grow else views.all(axis=-1)
    return mask


def changed(reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where two grey rasters of one size differ."""
    difference = blurred(np.abs(stretched(reference) - stretched(other)))
    height, width = difference.shape
    y, x = int(height * MARGIN), int(width * MARGIN)
    inside = np.zeros(difference.shape, dtype=bool)
    inside[y : height - y, x : width - x] = True
    mask = (difference >= max(LEAST_CHANGE, float(np.percentile(difference[inside], PERCENTILE)))) & inside
    opened = spread(spread(mask, SQUARE, False), SQUARE, True)
    return spread(spread(opened, SQUARE, True), SQUARE, False)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of places in a row, in reading order."""
    wide = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    steps = np.diff(wide, axis=1)
    row, first = np.nonzero(steps == 1)
    return row, first, np.nonzero(steps == -1)[1] - 1


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of each region of places that touch, corners too."""
    row, first, last = (a.tolist() for a in runs(mask))
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i in range(len(row)):
        while row[above] < row[i] - 1 or (row[above] == row[i] - 1 and last[above] < first[i] - 1):
            above += 1
        k = above
        while row[k] == row[i] - 1 and first[k] <= last[i] + 1:
            parent[root(k)] = root(i)
            k += 1
    boxes: dict[int, list[int]] = {}
    for i in range(len(row)):
        box = boxes.setdefault(root(i), [first[i], row[i], last[i], row[i], 0])
        box[:4] = min(box[0], first[i]), min(box[1], row[i]), max(box[2], last[i]), max(box[3], row[i])
        box[4] += last[i] - first[i] + 1
    return [(x0, y0, x1 - x0 + 1, y1 - y0 + 1, area) for x0, y0, x1, y1, area in boxes.values()]


def largest(found: list[tuple]) -> list[tuple]:
    """The MOST_REGIONS largest, and of those the ones of LEAST_AREA or more; ties from the top and the left."""
    return [r for r in sorted(found, key=lambda r: (-r[4], r[1], r[0]))[:MOST_REGIONS] if r[4] >= LEAST_AREA]


def compared(reference: np.ndarray | None, other: np.ndarray | None) -> tuple[float | None, list[tuple]]:
    """The changed share of places, and the regions."""
    if reference is None or other is None:
        return None, []
    height, width = min(reference.shape[0], other.shape[0]), min(reference.shape[1], other.shape[1])
    mask = changed(*(kernels.grey_of(p[:height, :width]) for p in (reference, other)))
    return int(mask.sum()) / mask.size, largest(regions(mask))


REGION = pa.struct([(c, pa.int32()) for c in ("x", "y", "width", "height", "area")])


def compare(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """pairs: key, reference, other (structs of width, height, channels, samples). key, changed_share, score, band, regions."""

    def pixels(raster: dict | None) -> np.ndarray | None:
        if not raster or not raster["samples"]:
            return None
        return np.frombuffer(raster["samples"], dtype=np.uint8).reshape(raster["height"], raster["width"], raster["channels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, found = [], []
            for k in range(batch.num_rows):
                share, own = compared(*(pixels(batch.column(c)[k].as_py()) for c in ("reference", "other")))
                shares.append(share)
                found.append([dict(zip(("x", "y", "width", "height", "area"), r, strict=True)) for r in own])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shares, pa.float64()), pa.array(found, pa.list_(REGION))], ["key", "changed_share", "regions"])

    named = pairs.select(F.col(key).alias("key"), "reference", "other")
    out = named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, changed_share double, regions array<struct<x int, y int, width int, height int, area int>>")
    score = F.when(F.col("changed_share").isNotNull(), F.least(F.lit(100.0), F.col("changed_share") * SHARE_POINTS + F.size("regions") * REGION_POINTS))
    band = F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").when(score.isNotNull(), "LOW")
    return out.select(F.col("key").alias(key), F.bround(F.col("changed_share") * 100, 2).alias("changed_percent"), F.bround(score, 1).alias("score"), band.alias("band"), "regions")
