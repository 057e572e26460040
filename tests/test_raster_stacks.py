"""Small rasters worked on together have the features that each has alone; a document's texture is made of one row."""

from __future__ import annotations

import re

import numpy as np
import pytest

from credenza import queries
from credenza.operators import kernels
from credenza.sources import rasters
from tests.test_rasters import flat, image, plain_edges
from tests.test_work_per_row import plan_of

SHAPES = [(1, 1), (1, 9), (13, 1), (24, 31), (3, 31), (40, 31), (8, 9), (16, 31), (2, 31)]


@pytest.mark.parametrize("pixels", [1, 600, 1 << 16])
def test_stacks_are_their_rasters(monkeypatch, pixels):
    monkeypatch.setattr(kernels, "PIXELS", pixels)
    greys = [kernels.grey_of(np.array(image(i, *shape, 1), dtype=np.uint8)) for i, shape in enumerate(SHAPES)]
    seen = []
    for own, stack in kernels.stacks(greys):
        found, totals = kernels.stacked_edges(stack), stack.sums(stack.grey)
        counts, _, places, _, texture, noise = kernels.stacked_blocks(stack, light=False)
        values, at = list(zip(texture.ravel().tolist(), noise.ravel().tolist(), strict=True)), 0
        for k, i in enumerate(own):
            start = int(stack.starts[k])
            assert {tuple(p) for p in np.argwhere(found[start : start + len(greys[i])]).tolist()} == plain_edges(greys[i].tolist())
            assert stack.sums(found)[k] == len(plain_edges(greys[i].tolist())) and totals[k] == int(greys[i].sum())
            n = int(counts[k]) * len(places)
            assert values[at : at + n] == [r[5:] for r in kernels.blocks_of(greys[i][:, :, None].astype(np.uint8))]
            at += n
        assert at == len(values) and not found[np.r_[0, stack.starts + stack.heights]].any()
        seen += own
    assert sorted(seen) == list(range(len(greys)))


def test_large_blocks_are_exact():
    """Sums whose products are no doubles."""
    n = np.array([[1 << 20]])
    totals, squares = n * 1019 - 1, n * 1019**2 - 1
    assert kernels.spreads(totals, squares, n).tolist() == [[kernels.variance(int(totals[0, 0]), int(squares[0, 0]), 1 << 20)]]


def test_texture_of_images_is_that_of_their_blocks(spark):
    """Also where ids repeat or are null, and where a file is broken."""
    files = [(i, bytearray(rasters.write_png(w, h, 1, flat(image(i, h, w, 1))))) for i, (h, w) in enumerate(SHAPES)]
    files += [(3, files[5][1]), (None, files[6][1]), (90, bytearray(b"broken")), (91, None)]
    df = spark.createDataFrame(files, "doc_id bigint, content binary").repartition(1)
    key = lambda r: (r.doc_id is None, r.doc_id)
    want = sorted(kernels.texture(kernels.marked_blocks(df), kept=("lap_var", "edge_density")).collect(), key=key)
    for frame in (df, rasters.read_rasters(df)):
        got = sorted(kernels.image_texture(frame).collect(), key=key)
        assert [r.doc_id for r in got] == [r.doc_id for r in want] == [*range(len(SHAPES)), None]
        for g, w in zip(got, want, strict=True):
            assert tuple(g)[1:] == pytest.approx(tuple(w)[1:] if g.doc_id != 3 else (*tuple(w)[1:4], *tuple(g)[4:]), rel=1e-12, abs=1e-12)


def test_texture_sorts_once_and_moves_a_row_per_document(spark):
    plan = plan_of(queries.queries()["raster_texture"](spark, "/root/testdata/sf0.001"))
    assert "array_sort" not in plan and "stddev" not in plan and not re.search(r"MapInArrow.*row#", plan)
