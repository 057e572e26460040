"""Queries that read and make their rows once, however deep or wide the work on them is."""

from __future__ import annotations

import random

import duckdb
import pytest

from credenza import queries
from credenza.operators import history
from credenza.plans import relational
from credenza.plans.dialect import DUCK
from credenza.sources import manifests
from tests.oracle import assert_same
from tests.test_work_per_row import plan_of

SF = "/root/testdata/sf0.001"


def test_provenance_makes_and_reads_every_file_once(spark):
    found = plan_of(queries.queries()["provenance"](spark, SF))
    assert found.count("MapInArrow") == 2 and "Join" not in found and found.count("hashpartitioning(doc_id") == found.count("Exchange") == 2


def test_rolled_up_manifests_of_odd_files(spark):
    schema = "doc_id int, manifest string, position int, active boolean, generator string, signed boolean, source_type string, actions array<string>, ingredients array<string>"
    long = [(3, f"m{k}", k, k == 39, f"g{k}", True, None, [f"a{k}"], [f"m{k - 1}"] if k else ["m39"]) for k in range(40)]
    rows = [
        (1, "a", 0, False, "x", True, "s", ["one"], ["b", "none"]), (1, "b", 1, True, "y", False, None, ["two", "three"], ["a", "b", None]),
        (2, "a", 0, False, "x", True, None, ["one"], None),  # none is active
        (4, None, 0, True, "z", True, "t", ["lost"], ["a"]), (4, "a", 1, False, None, None, None, [], []),  # the active one has no name
        (None, "a", 0, True, "n", True, None, ["none"], []),
        (5, "a", 0, True, "x", True, None, ["late"], ["b"]), (5, "b", 1, False, None, False, None, ["early"], []), (5, "b", 2, False, None, False, None, ["again"], ["c"]), (5, "c", 3, False, None, False, None, ["first"], ["a"]),  # a name twice
        *long,
    ]
    got = {r.doc_id: tuple(r)[1:] for r in manifests.rolled_up(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    history = ">".join(f"a{k}" for k in range(7, 40))
    assert got == {
        1: (2, 1, "y", None, 1, "one>two>three"), 2: (1, 1, None, None, None, ""), 4: (2, 1, "z", "t", None, ""), None: (1, 1, "n", None, None, ""),
        5: (4, 1, "x", None, 2, "first>early>again>late"), 3: (40, 40, "g39", None, manifests.DEEPEST, history),
    }


def test_nearest_pair_on_odd_vectors_is_the_sql(spark, tmp_path):
    rng = random.Random(5)
    vector = lambda: [rng.choice((-1.5, -0.1, 0.1, 0.7, 1.3, 2.9)) for _ in range(6)]
    rows = [(i, vector()) for i in range(0, 900)] + [(i, None) for i in (1000, 1001)] + [(1002, [None] * 6), (1003, [1.0, None, 3.0, 4.0, 5.0, 9.0]), (1004, [float("nan")] * 6), (1005, [9.0, 9.0]), (1006, [float("-inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (1100, None), (1200, [1.0, None, 2.0, 2.0, 2.0, 2.0]), (5, vector()), (None, vector())]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    clean = [r for r in rows if r[0] is not None and r[0] < 1000]
    spark.createDataFrame(clean, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/clean/embeddings.parquet")
    for folder in (f"{tmp_path}", f"{tmp_path}/clean"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
        vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
        for blocks in (None, 7):
            assert_same(history.nearest_pair(vectors.filter("vec_id % 100 = 0"), vectors, blocks=blocks), con, relational.knn_ratio_test(DUCK))


def test_nearest_pair_scores_blocks_and_sorts_few_rows(spark):
    found = queries.queries()["knn_ratio_test"](spark, SF)
    assert "FlatMapGroupsInArrow" in plan_of(found) and "Join" not in plan_of(found)


@pytest.mark.parametrize("name", ["fabrication_signals", "fabrication_verdicts", "verification_overall"])
def test_evidence_of_a_document_is_made_in_its_row(spark, name):
    found = plan_of(queries.queries()[name](spark, SF))
    assert "Join" not in found and "Aggregate" not in found and found.count("Scan parquet") == 1
    assert found.count("Exchange") == 1  # orders, dealt before their rows are made


def test_ocr_tokens_leave_in_arrow_batches_of_many_tasks(spark):
    found = queries.queries()["udtf_ocr_tokens"](spark, SF)
    assert "ArrowEvalPythonUDTF" in plan_of(found) and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
