"""Groups read one behind the other: over the edges of batches, and the same whatever order rows come in."""

from __future__ import annotations

from credenza.operators import sequence


def test_groups_span_batches_and_ties_do_not_depend_on_the_input(spark):
    rows = [(d, "name", s, f"holder {v}", float(c)) for d in (1, 2, None) for s, v, c in [(1, "abcdef", 3), (1, "zzzzzz", 9), (1, "abcdeX", 9), (2, "abcdef", 4), (3, "zzzzzY", 1), (4, "abcdef", 2)]]
    boxes = [(d, b, x, 0, 40, 20, 5.0) for d in (1, 2) for b, x in [(1, 0), (1, 18), (1, 36), (2, 54), (2, 72)]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for size, step in (("2", 1), ("10000", -1)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            made = spark.createDataFrame(rows[::step], "doc_id bigint, field string, seq bigint, value string, conf double").coalesce(1)
            page = spark.createDataFrame(boxes[::step], "doc_id bigint, box_id bigint, x bigint, y bigint, w bigint, h bigint, conf double").coalesce(1)
            found.append([sorted(map(str, df.collect())) for df in (sequence.leader_clusters(made, 0.95), sequence.suppressed(page, 0.30))])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len(found[0][0]) == 12 and len(found[0][1]) == 6
