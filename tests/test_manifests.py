"""Stores written and read back, broken ones, and histories against a walk in Python."""

from __future__ import annotations

import random
import struct

import pytest

from credenza.sources import manifests as m
from credenza.sources import rasters

PNG = rasters.write_png(2, 2, 1, bytes(4))
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xd9"


def one(name, ingredients=(), actions=("c2pa.created",), source=None, signed=True):
    return {"manifest": name, "generator": f"g/{name}", "signed": signed, "source_type": source, "actions": list(actions), "ingredients": list(ingredients)}


@pytest.mark.parametrize("value", [0, 23, 24, 255, 256, 70_000, 1 << 40, -1, -300, "", "é" * 300, b"\0\1", [], [1, [2, {"a": None}]], {"k": True, "z": [False] * 30}])
def test_cbor_round_trip(value):
    assert m.cbor(m.to_cbor(value)) == (value, len(m.to_cbor(value)))


def test_cbor_of_other_writers():
    assert m.cbor(b"\xf9\x3c\x00")[0] == 1.0 and m.cbor(struct.pack(">Bd", 0xFB, 1.5))[0] == 1.5 and m.cbor(b"\xc1\x05")[0] == 5
    assert m.cbor(b"\x9f\x01\x02\xff")[0] == [1, 2] and m.cbor(b"\x7f\x61a\x61b\xff")[0] == "ab" and m.cbor(b"\xbf\x61a\x01\xff")[0] == {"a": 1}
    for broken in (b"\x65ab", b"", b"\x1c", b"\x81" * 100):
        with pytest.raises((ValueError, IndexError)):
            m.cbor(broken)


@pytest.mark.parametrize("most", [64, 500, 65_000])
def test_stores_in_files(most):
    own = [one("a", actions=("x", "y"), source="trained"), one("b", ("a",), signed=False), one("c", ("a", "b"))]
    want = [("a", 0, False, "g/a", True, "trained", ["x", "y"], []), ("b", 1, False, "g/b", False, None, ["c2pa.created"], ["a"]), ("c", 2, True, "g/c", True, None, ["c2pa.created"], ["a", "b"])]
    store = m.write_store(own)
    assert m.manifests_of(m.in_png(PNG, store)) == want and m.manifests_of(m.in_jpeg(JPEG, store, most)) == want
    assert rasters.read(m.in_png(PNG, store)) == rasters.read(PNG)


def test_broken_files(spark):
    good = m.in_png(PNG, m.write_store([one("a")]))
    at = good.index(b"cbor") + 4
    files = [None, b"", PNG, JPEG, good[:60], good[:at] + b"\x1c" + good[at + 1 :], m.in_jpeg(JPEG, b"\0\0\0\x09jumb?"), good]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id int, content binary")
    got = {r.doc_id: r for r in m.read_manifests(df).collect()}
    assert set(got) == {5, 7} and got[5].actions == [] and got[5].generator == "g/a" and got[7].actions == ["c2pa.created"] and got[7].active
    assert m.read_manifests(df.limit(0)).collect() == []


def test_histories(spark, tmp_path):
    """Random graphs with several ways, cycles and names that no manifest has."""
    rng = random.Random(1)
    graphs = {d: [(f"m{k}", [f"m{rng.randrange(n + 1)}" for _ in range(rng.randrange(3))]) for k in range(n)] for d in range(25) for n in [rng.randrange(1, 7)]}
    rows = [(d, name, k == len(g) - 1, own) for d, g in graphs.items() for k, (name, own) in enumerate(g)]
    df = spark.createDataFrame(rows, "doc_id int, manifest string, active boolean, ingredients array<string>")
    got = {(r.doc_id, r.manifest): r.depth for r in m.histories(df, f"{tmp_path}/h").collect()}
    want = {}
    for d, g in graphs.items():
        own, level, depth = dict(g), [g[-1][0]], 0
        while level:
            for name in level:
                want.setdefault((d, name), depth)
            level = [i for name in level for i in own[name] if i in own and (d, i) not in want]
            depth += 1
    assert got == want and max(want.values()) >= 3 and spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
