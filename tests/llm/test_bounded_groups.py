"""What a group of the similarity join holds is bounded, however few partitions there are."""

from __future__ import annotations

import random

from credenza.llm import jaccard_join
from tests.llm import brute


def near_copies(n: int) -> list[tuple]:
    rng = random.Random(21)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(6, 60))] for _ in range(40)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        out.append((i, " ".join(words)))
    return out


def test_groups_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    for name in ("gather", "compare"):
        own = getattr(jaccard_join, name)

        def noted(*args, own=own, name=name):
            run, folder = own(*args), str(tmp_path / name)

            def counted(table):
                import uuid

                with open(f"{folder}-{uuid.uuid4().hex}", "w") as f:
                    f.write(str(table.num_rows))
                return run(table)

            return counted

        monkeypatch.setattr(jaccard_join, name, noted)
    monkeypatch.setattr(jaccard_join, "POSTINGS", 64, raising=False)
    monkeypatch.setattr(jaccard_join, "NODES", 256, raising=False)
    data = near_copies(600)
    frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(frame, chunk=16).collect()}
    assert got == set(brute.components(data))
    sizes = [int(p.read_text()) for p in tmp_path.glob("compare-*")]
    # A gathering is in one group with all its nodes, so that some hold more than the bound.
    assert sum(sizes) > 20 * 256 and max(sizes) < 4 * 256
    assert len(list(tmp_path.glob("gather-*"))) > 20
