"""Features of rasters: the quality measures and the texture of blocks that the rules read.

All are integers, or ratios of integers, of the samples until the last division, so that they don't depend on the order of
summing. Rasters come as rows (see sources/rasters.py), one at a time or some small ones of one width together; what a task holds
is bounded by the largest of them.

Defined cases: a raster of nulls, or one without pixels, has null features and no blocks; one pixel or one row is its own neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.sources import rasters as raster_files

#: Weights of red, green and blue in grey (of 2**14); glare is paler than the one and brighter than the other;
#: gradients at which an edge goes on and starts; the greatest tilt of a line that tells the skew, and the edge places that make
#: a line (or a fifth of the shorter side); blocks along each side;
#: least scale of a block's deviation, and deviations that make an outlier; least mean under a variation.
GREY = (4899, 9617, 1868)
PALE, BRIGHT = 35, 245
WEAK, STRONG = 60, 160
LEVEL_DEGREES, LINE, SIDES = 15, 80, 5
GRID = 8
LEAST_SCALE, OUTLIER, LEAST_MEAN = 0.12, 3.5, 0.1

LIGHT = "brightness double, contrast double, laplacian_variance double"
BLOCKS = "row int, col int, n int, mean double, variance double, texture double, noise double"
#: Rasters whose rows go out together, and pixels that are worked on together.
ROWS, PIXELS = 256, 1 << 16
QUALITY = "width int, height int, brightness double, contrast double, laplacian_variance double, skew_deg double, glare_ratio double, edge_density double"


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """(height, width, channels) to grey values, rounded."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int32)
    return (pixels[:, :, :3].astype(np.int32) @ np.array(GREY, dtype=np.int32) + (1 << 13)) >> 14


def mirrored(n: int, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n places cut into equal parts: the ends of the parts, and each place's neighbour before and after within its part,
    mirrored at the part's edges."""
    ends = np.arange(parts + 1) * n // parts
    before, after = np.arange(n) - 1, np.arange(n) + 1
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        if z > a:
            before[a], after[z - 1] = min(a + 1, z - 1), max(z - 2, a)
    return ends, before, after


def laplacian(grey: np.ndarray, rows: tuple, columns: tuple) -> np.ndarray:
    """The sum of the four neighbours less four times the value."""
    return grey[rows[1]] + grey[rows[2]] + grey[:, columns[1]] + grey[:, columns[2]] - 4 * grey


def variance(total: int, squares: int, n: int) -> float:
    """From the sums of values and squares, without loss before the division."""
    return (n * int(squares) - int(total) ** 2) / (n * n)


class Stack:
    """Grey rasters of one width as one array, one below the other, with a row of zeros above, between and below them."""

    def __init__(self, greys: list[np.ndarray]):
        self.heights = np.array([len(g) for g in greys])
        self.starts = 1 + np.cumsum(self.heights + 1) - (self.heights + 1)
        self.grey = np.zeros((int(self.heights.sum()) + len(greys) + 1, greys[0].shape[1]), dtype=np.int32)
        for start, g in zip(self.starts.tolist(), greys, strict=True):
            self.grey[start : start + len(g)] = g

    def mirrored(self, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As mirrored(), of the rows of each raster: ends has a row per raster; the rows between are their own neighbours."""
        ends = self.starts[:, None] + np.arange(parts + 1) * self.heights[:, None] // parts
        a, z = (x[ends[:, 1:] > ends[:, :-1]] for x in (ends[:, :-1], ends[:, 1:]))
        before, after = np.arange(len(self.grey)) - 1, np.arange(len(self.grey)) + 1
        before[a], after[z - 1] = np.minimum(a + 1, z - 1), np.maximum(z - 2, a)
        between = np.r_[0, self.starts + self.heights]
        before[between] = after[between] = between
        return ends, before, after

    def sums(self, values: np.ndarray) -> list[int]:
        """Of each raster."""
        return np.add.reduceat(values.sum(axis=1, dtype=np.int64), self.starts).tolist()


def stacks(greys: list[np.ndarray]) -> Iterator[tuple[list[int], Stack]]:
    """Stacks of about PIXELS pixels, or of one raster, and which of the rasters they hold."""
    by_width: dict[int, list[int]] = {}
    for i, g in enumerate(greys):
        by_width.setdefault(g.shape[1], []).append(i)
    for width, found in by_width.items():
        own, held = [], 0
        for i in found:
            if own and held + greys[i].size > PIXELS:
                yield own, Stack([greys[k] for k in own])
                own, held = [], 0
            own.append(i)
            held += (len(greys[i]) + 1) * width
        yield own, Stack([greys[k] for k in own])


def edges(grey: np.ndarray) -> np.ndarray:
    """Edge places: Sobel gradients, greatest along their direction, from STRONG ones on to WEAK ones that touch."""
    return stacked_edges(Stack([grey]))[1:-1]


def stacked_edges(stack: Stack) -> np.ndarray:
    """Edge places of all rasters of a stack; none in the rows between."""
    grey = stack.grey
    _, up, down = stack.mirrored()
    _, left, right = mirrored(grey.shape[1])
    smooth_y, smooth_x = grey[up] + 2 * grey + grey[down], grey[:, left] + 2 * grey + grey[:, right]
    gx, gy = smooth_y[:, right] - smooth_y[:, left], smooth_x[down] - smooth_x[up]
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)

    def shifted(dy: int, dx: int) -> np.ndarray:
        return around[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]

    # Which of four directions the gradient has: tangents of 22.5 and 67.5 degrees as ratios of integers.
    ax, ay = np.abs(gx) << 15, np.abs(gy) << 15
    flat, steep = ay < 13573 * np.abs(gx), ay > 13573 * np.abs(gx) + (ax << 1)
    same = (gx < 0) == (gy < 0)
    across = np.where(flat, (size > shifted(0, -1)) & (size >= shifted(0, 1)), np.where(steep, (size > shifted(-1, 0)) & (size >= shifted(1, 0)), np.where(same, (size > shifted(-1, -1)) & (size > shifted(1, 1)), (size > shifted(-1, 1)) & (size > shifted(1, -1)))))
    weak = across & (size > WEAK)
    found = np.pad(weak & (size > STRONG), 1)
    # Places of the padded array that can still be found, and those found last.
    open_ = np.pad(weak, 1) & ~found
    line = found.shape[1]
    beside = np.array([-line - 1, -line, -line + 1, -1, 1, line - 1, line, line + 1])
    fresh, places, free = np.flatnonzero(found), found.ravel(), open_.ravel()
    last = np.empty(len(places), dtype=np.int64)
    while len(fresh):  # from each place found last to its eight neighbours, each taken once
        near = (fresh[:, None] + beside).ravel()
        near = near[free[near]]
        last[near] = numbers = np.arange(len(near))
        fresh = near[last[near] == numbers]
        places[fresh], free[fresh] = True, False
    return found[1:-1, 1:-1]


def skew_of(found: np.ndarray) -> float:
    """The tilt, in whole degrees within LEVEL_DEGREES, of the line with the most edge places on it (ties: nearer to level,
    then upwards); 0 if none has enough."""
    y, x = np.nonzero(found)
    best = (max(LINE, min(found.shape) // SIDES) - 1, 0, 0)
    for degrees in sorted(range(-LEVEL_DEGREES, LEVEL_DEGREES + 1), key=abs):
        angle = np.radians(degrees)
        away = np.floor(y * np.cos(angle) - x * np.sin(angle) + 0.5).astype(np.int64)
        most = int(np.bincount(away - away.min()).max()) if len(away) else 0
        best = max(best, (most, -abs(degrees), -degrees))
    return float(-best[2])


def light_of(grey: np.ndarray) -> tuple[float, float, float]:
    """The columns of LIGHT."""
    n = grey.size
    lap = laplacian(grey, mirrored(grey.shape[0]), mirrored(grey.shape[1]))
    return int(grey.sum()) / n, variance(grey.sum(), (grey * grey).sum(), n) ** 0.5, variance(lap.sum(), (lap * lap).sum(), n)


def quality_of(pixels: np.ndarray) -> tuple:
    """The columns of QUALITY."""
    height, width, channels = pixels.shape
    grey = grey_of(pixels)
    n = grey.size
    colour = pixels[:, :, :3].astype(np.int64) if channels >= 3 else np.repeat(pixels[:, :, :1].astype(np.int64), 3, axis=2)
    top, low = colour.max(axis=2), colour.min(axis=2)
    pale = 2 * 255 * (top - low) < (2 * PALE - 1) * top  # 255 (top - low) / top, rounded, below PALE
    found = edges(grey)
    return (
        width, height, *light_of(grey),
        skew_of(found), int((pale & (top > BRIGHT)).sum()) / n, int(found.sum()) / n,
    )


def spreads(totals: np.ndarray, squares: np.ndarray, n: np.ndarray) -> np.ndarray:
    """variance() of each block."""
    # Integers below 2**53 are doubles; larger ones are divided as they are.
    if int(n.max(initial=0)) * int(squares.max(initial=0)) < 1 << 53 and int(n.max(initial=0)) < 1 << 26:
        return (n * squares - totals**2) / (n * n)
    own = zip(totals.ravel().tolist(), squares.ravel().tolist(), np.broadcast_to(n, totals.shape).ravel().tolist(), strict=True)
    return np.array([variance(*x) for x in own]).reshape(totals.shape)


def stacked_blocks(stack: Stack, grid: int = GRID, light: bool = True) -> tuple[np.ndarray, ...]:
    """Of the blocks of all rasters of a stack, in lines of blocks: n, texture and noise (see blocks_of), and with `light` the mean
    and variance of grey; before them how many lines each raster has, and the numbers of the lines and columns. Blocks without
    pixels are left out."""
    grey = stack.grey
    rows, columns = stack.mirrored(grid), mirrored(grey.shape[1], grid)
    lap = laplacian(grey, rows, columns)
    across = grey[:, columns[1]] + 2 * grey + grey[:, columns[2]]
    noise = np.maximum(0, grey - ((across[rows[1]] + 2 * across + across[rows[2]] + 8) >> 4))
    heights, widths = np.diff(rows[0], axis=1), np.diff(columns[0])
    lines, places = heights > 0, np.flatnonzero(widths)
    tops, lefts = rows[0][:, :-1][lines], columns[0][:-1][places]
    n = heights[lines][:, None] * widths[places]
    # The rows between are zeros, and so are the features there: a raster's last line may run on into them.
    sums = [[np.add.reduceat(np.add.reduceat(x, lefts, axis=1, dtype=np.int64), tops, axis=0) for x in (values, values * values)] for values in ([lap, noise, grey] if light else [lap, noise])]
    found = [spreads(*own, n) for own in sums]
    more = [sums[2][0] / n, found[2]] if light else []
    return lines.sum(axis=1), np.nonzero(lines)[1], places, n, np.log1p(found[0]), found[1], *more


def blocks_of(pixels: np.ndarray, grid: int = GRID) -> list[tuple]:
    """(row, column, n, mean, variance, texture, noise) of each block of the grid that has pixels: mean and variance of
    grey, log(1 + variance) of its Laplacian, variance of what a 3 by 3 blur takes off."""
    _, lines, places, n, texture_, noise, mean, spread = (x.tolist() for x in stacked_blocks(Stack([grey_of(pixels)]), grid))
    return [(r, c, *own) for r, *line in zip(lines, n, mean, spread, texture_, noise, strict=True) for c, *own in zip(places, *line, strict=True)]


def _map_rasters(images: DataFrame, key: str, schema: str, fn: Callable[[np.ndarray | None], list[tuple]]) -> DataFrame:
    """Each image to rows of `schema` under its key. Images are rasters, or files (a column content), which are read here: their
    samples then cross to no other process."""
    files = "content" in images.columns
    inputs = ("content",) if files else ("width", "height", "channels", "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("key").type, *(pa.int32() if part.split()[1] == "int" else pa.float64() for part in schema.split(", "))]
            for start in range(0, batch.num_rows, ROWS):
                rows = []
                for k in range(start, min(start + ROWS, batch.num_rows)):
                    name, *image = (batch.column(c)[k].as_py() for c in ("key", *inputs))
                    width, height, channels, samples = (raster_files.read(image[0]) or (None,) * 4) if files else image
                    pixels = np.frombuffer(samples, dtype=np.uint8).reshape(height, width, channels) if samples else None
                    rows += [(name, *row) for row in fn(pixels)]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", *(part.split()[0] for part in schema.split(", "))])

    named = images.withColumnRenamed(key, "key").select("key", *inputs)
    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, {schema}").withColumnRenamed("key", key)


def quality(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """The quality features of each raster or file: key and the columns of QUALITY."""
    return _map_rasters(images, key, QUALITY, lambda pixels: [(None,) * 8 if pixels is None else quality_of(pixels)])


def light(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Those of the quality features that need no edges: key and the columns of LIGHT."""
    return _map_rasters(images, key, LIGHT, lambda pixels: [(None,) * 3 if pixels is None else light_of(grey_of(pixels))])


def blocks(images: DataFrame, key: str = "doc_id", grid: int = GRID) -> DataFrame:
    """A row per block: key, row, col, n, mean, variance, texture, noise."""
    return _map_rasters(images, key, BLOCKS, lambda pixels: [] if pixels is None else blocks_of(pixels, grid))


def marked_blocks(images: DataFrame, key: str = "doc_id", grid: int = GRID) -> DataFrame:
    """The same with lap_var and edge_density of the block's whole image, which is read once for both."""

    def of(pixels: np.ndarray) -> list[tuple]:
        grey = grey_of(pixels)
        whole = (light_of(grey)[2], int(edges(grey).sum()) / grey.size)
        return [(*block, *whole) for block in blocks_of(pixels, grid)]

    return _map_rasters(images, key, f"{BLOCKS}, lap_var double, edge_density double", lambda pixels: [] if pixels is None else of(pixels))


def textures(images: DataFrame, key: str = "doc_id", grid: int = GRID) -> DataFrame:
    """A row per image that has blocks: key, texture and noise of all its blocks (arrays), and lap_var and edge_density of the
    whole. Images are read once, and worked on in stacks."""
    files = "content" in images.columns
    inputs = ("content",) if files else ("width", "height", "channels", "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            greys, rows = [], []
            for k, image in enumerate(zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)):
                width, height, channels, samples = (raster_files.read(image[0]) or (None,) * 4) if files else image
                if samples:
                    greys.append(grey_of(np.frombuffer(samples, dtype=np.uint8).reshape(height, width, channels)))
                    rows.append(k)
            for own, stack in stacks(greys):
                lap = laplacian(stack.grey, stack.mirrored(), mirrored(stack.grey.shape[1]))
                sizes = (stack.heights * stack.grey.shape[1]).tolist()
                lap_var = [variance(*x) for x in zip(stack.sums(lap), stack.sums(lap * lap), sizes, strict=True)]
                density = [n / size for n, size in zip(stack.sums(stacked_edges(stack)), sizes, strict=True)]
                lines, _, places, _, *values = stacked_blocks(stack, grid, light=False)
                ends = pa.array(np.r_[0, np.cumsum(lines * len(places))], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([rows[i] for i in own], pa.int64())), *lists, pa.array(lap_var), pa.array(density)], ["key", "textures", "noises", "lap_var", "edge_density"])

    named = images.withColumnRenamed(key, "key").select("key", *inputs)
    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, textures array<double>, noises array<double>, lap_var double, edge_density double").withColumnRenamed("key", key)


def texture(of_blocks: DataFrame, key: str = "doc_id", kept: tuple[str, ...] = ()) -> DataFrame:
    """Robust statistics of each image's blocks: texture_cv, noise_cv and texture_outlier_ratio, the share of blocks whose texture
    is OUTLIER or more scaled median deviations from the median. At most grid x grid values an image. kept: columns of the whole image."""
    spread = lambda c: F.stddev_pop(c) / F.greatest(F.avg(F.abs(c)), F.lit(LEAST_MEAN))
    sums = of_blocks.groupBy(key).agg(spread("texture").alias("texture_cv"), spread("noise").alias("noise_cv"), F.collect_list("texture").alias("__t"), *[F.first(c).alias(c) for c in kept])
    return _with_outliers(sums, key, kept)


def image_texture(images: DataFrame, key: str = "doc_id", grid: int = GRID) -> DataFrame:
    """texture() of all blocks of each key's images, with lap_var and edge_density, from one row per image."""
    kept = ("lap_var", "edge_density")
    lists = textures(images, key, grid).groupBy(key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("textures", "noises")], *[F.first(c).alias(c) for c in kept])

    def added(state, x):
        """Number, mean and summed squares of the deviations, as stddev_pop has them."""
        step = (x - state["mean"]) / (state["n"] + 1)
        return F.struct((state["n"] + 1).alias("n"), (state["mean"] + step).alias("mean"), (state["squares"] + (x - state["mean"]) * (x - state["mean"] - step)).alias("squares"))

    def spread(values: str):
        none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")])
        mean = F.aggregate(values, F.lit(0.0), lambda total, x: total + F.abs(x)) / F.size(values)
        return F.aggregate(values, none, added, lambda state: F.sqrt(state["squares"] / state["n"])) / F.greatest(mean, F.lit(LEAST_MEAN))

    sums = lists.select(key, spread("textures").alias("texture_cv"), spread("noises").alias("noise_cv"), F.col("textures").alias("__t"), *kept)
    return _with_outliers(sums, key, kept)


def _with_outliers(sums: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    def median(ordered: str):
        n = F.size(ordered)
        return (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2

    def each(values: str, other, fn):
        """fn of each value and `other`, which is made once: a lambda that names it would have it made for every value."""
        return F.zip_with(values, F.array_repeat(other, F.size(values)), fn)

    ordered = sums.withColumn("__o", F.sort_array("__t"))
    centred = ordered.withColumn("__d", F.sort_array(each("__o", median("__o"), lambda x, m: F.abs(x - m))))
    scale = F.greatest(1.4826 * median("__d"), F.lit(LEAST_SCALE))
    out = F.size(F.filter(each("__d", scale, lambda d, s: d / s >= OUTLIER), lambda x: x)) / F.size("__d")
    return centred.select(key, "texture_cv", "noise_cv", out.alias("texture_outlier_ratio"), *kept)
