"""What the similarity join leaves in the shared folder: the tables that its result reads, nothing of the steps before."""

from __future__ import annotations

import glob

from credenza.llm import jaccard_join
from credenza.llm.common import shared_dir


def test_spent_tables_are_deleted(spark):
    folder = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{folder}/credenza-*"))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "other text of six words here"), (4, None)], "doc_id bigint, text string")
    got = jaccard_join.similarity_classes(docs)
    left = {path.split("credenza-")[-1].split("-")[0] for path in set(glob.glob(f"{folder}/credenza-*")) - before}
    assert left == {"sets", "nodes", "labels"}
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
