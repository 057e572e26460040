"""Rasters are read once, in many tasks and in small batches."""

from __future__ import annotations

import pyarrow as pa

from credenza import queries
from credenza.operators import kernels
from credenza.sources import rasters
from tests.test_work_per_row import plan_of


def files_of(spark, n: int):
    made = [(i, bytearray(rasters.write_png(8, 8 + i % 3, 1, bytes(range(i, i + 8 * (8 + i % 3)))))) for i in range(n)]
    return spark.createDataFrame([*made, (n, bytearray(b"broken")), (n + 1, None)], "doc_id bigint, content binary")


def test_files_have_the_features_of_their_rasters(spark):
    files = files_of(spark, 20)
    rows = rasters.read_rasters(files)
    for of in (kernels.quality, kernels.light, kernels.blocks, kernels.marked_blocks):
        assert sorted(map(str, of(files).collect())) == sorted(map(str, of(rows).collect()))
    light = {r.doc_id: r for r in kernels.light(files).collect()}
    for r in kernels.quality(files).collect():
        assert (r.brightness, r.contrast, r.laplacian_variance) == (light[r.doc_id].brightness, light[r.doc_id].contrast, light[r.doc_id].laplacian_variance)


def test_texture_reads_every_file_once_in_all_partitions(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.queries()["raster_texture"](spark, sf_dir)
    assert plan_of(found).count("MapInArrow") == 2
    assert queries._raster_files(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edited_copies_go_out_in_small_batches():
    content = [rasters.write_png(4, 4, 1, bytes(16))] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(content, pa.binary())], ["doc_id", "content"])
    sizes = [b.num_rows for b in queries._edited([batch])]
    assert sum(sizes) == 600 and max(sizes) <= kernels.ROWS
