"""Search by grams equals the scan, and reads few of the index's rows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from credenza.operators import history, search_index

SCHEMA = "id bigint, name string, number string"


def test_search_is_the_scan(spark, tmp_path):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdéX1-_%") for _ in range(n))
    rows = [(rng.randrange(10**12) if i % 7 else -i, None if i % 11 == 0 else word(rng.randrange(9)), word(rng.randrange(6))) for i in range(800)] + [(5, "abc", "x"), (5, "abc abc", ""), (None, "abc", None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    search_index.build(table, f"{tmp_path}/index", ["name", "number"], "id", 30)
    index = spark.read.parquet(f"{tmp_path}/index")
    for q in ("ab", "abc", " ABC ", "x1", "_%", "%", "dé1", "é-_%", "bcdéx", "zz") :
        if len(q.strip()) < 2:
            with pytest.raises(ValueError):
                search_index.search(index, table, q, ["name", "number"], "id")
            continue
        got = search_index.search(index, table, q, ["name", "number"], "id", 10_000).collect()
        want = [r for r in history.search(table, q, ["name", "number"], "id", 10_000).collect() if r.id is not None]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), q
        assert [r.id for r in got] == sorted((r.id for r in got), reverse=True)
    assert index.count() > 300 and index.filter(index.gram.isin(*search_index.wanted("abcd"))).count() < 0.05 * index.count()
    newest = search_index.search(index, table, "ab", ["name", "number"], "id", 3).collect()
    assert [r.id for r in newest] == [r.id for r in history.search(table, "ab", ["name", "number"], "id", 3).collect()]


def test_readers_skip_other_grams(spark, tmp_path):
    table = spark.createDataFrame([(i, f"name {i}", str(i * 7919)) for i in range(500)], SCHEMA)
    search_index.build(table, f"{tmp_path}/index", ["name", "number"], "id")
    plan = search_index.candidates(spark.read.parquet(f"{tmp_path}/index"), "name 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "ReadSchema: struct<gram:string,block:bigint,ids:array<bigint>>" in plan


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], SCHEMA)
    search_index.build(table, f"{tmp_path}/index", ["name"], "id")
    index = spark.read.schema("gram string, block bigint, ids array<bigint>").parquet(f"{tmp_path}/index")
    assert search_index.search(index, table, "ab", ["name"], "id").collect() == []


def test_lists_are_whole_and_made_once(spark, tmp_path, monkeypatch):
    """The index has each gram's ids of each block in one list, however many blocks and postings are worked on together."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé😀\x00 X") for _ in range(n))
    rows = [(rng.randrange(-300, 2000), None if i % 13 == 0 else word(rng.randrange(7)), word(rng.randrange(4))) for i in range(900)] + [(None, "abc", "ab")]
    want: dict[tuple[str, int], set[int]] = {}
    for key, *texts in rows:
        for text in (t.lower() for t in texts if t and key is not None):
            for gram in (text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)):
                want.setdefault((gram, key >> 6), set()).add(key)
    expected = sorted((gram, block, sorted(ids)) for (gram, block), ids in want.items())
    search_index.build(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/index", ["name", "number"], "id", 6)
    index = spark.read.parquet(f"{tmp_path}/index")
    assert sorted((r.gram, r.block, list(r.ids)) for r in index.collect()) == expected
    # The same in memory, with few rows and postings at a time.
    monkeypatch.setattr(search_index, "ROWS", 10)
    monkeypatch.setattr(search_index, "POSTINGS", 7)
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0] >> 6)
    table = pa.table({"id": [r[0] for r in known], "block": [r[0] >> 6 for r in known], "c0": [(r[1] or "").lower() for r in known], "c1": [r[2].lower() for r in known]})
    found = [row for batch in search_index.postings(6)(iter(table.to_batches(max_chunksize=4))) for row in batch.to_pylist()]
    assert sorted((r["gram"], r["block"], r["ids"]) for r in found) == expected
