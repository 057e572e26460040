"""Words, shingles and tree searches made for a whole slice or gathering at once, against one at a time."""

from __future__ import annotations

import random

import numpy as np

from credenza.llm import jaccard_join
from credenza.llm.common import TABLED, word_hashes


def test_words_of_a_slice_are_the_words_of_each_text():
    rng = random.Random(5)
    pieces = [b"a", b"B", b"b", b" ", b"\t", b"\n", b"\x0b", b"\x1c", b"\x00", b"\xc2\x85", b"\xc3\xa9", b"\xe3\x80\x80", b"x" * TABLED, b"y" * 70]
    texts = [b"", b" ", b"a", *[b"".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(400)], b"Long " * 5000, b"z" * 100_000]
    words = [text.lower().split() for text in texts]
    for most in (1, 50, 1 << 18):
        found, counts = word_hashes(texts, most)
        assert counts.tolist() == [len(own) for own in words]
        flat = [word for own in words for word in own]
        assert len(set(zip(flat, found.tolist(), strict=True))) == len(set(flat)) == len(set(found.tolist()))
    assert [len(x) for x in word_hashes([])] == [0, 0] and [len(x) for x in word_hashes([b"", b" "])] == [0, 2]


def test_shingles_of_a_slice_are_those_of_each_text():
    rng = random.Random(6)
    texts = [b" ".join(rng.choice([b"a", b"b", b"C"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    flat, sizes = jaccard_join.shingle_sets(texts, 5)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        own = text.lower().split()
        n = min(5, len(own))
        assert b - a == (len({tuple(own[i : i + n]) for i in range(len(own) - n + 1)}) if own else 0)
        assert np.array_equal(flat[a:b], jaccard_join.shingles(text, 5))


def test_points_go_down_the_tree_together():
    rng = np.random.default_rng(7)
    rows = [jaccard_join.point_of(rng.integers(0, 1 << 60, n, dtype=np.uint64) // np.uint64(w) * np.uint64(w)) for n, w in zip(rng.integers(1, 900, 200), rng.choice([1, 512], 200), strict=True)]
    points = jaccard_join.points_of(rows)
    assert points.dtype == np.uint16 and [p.sum() for p in points] == [np.frombuffer(r, f"<u{len(r) // jaccard_join.GROUPS}").sum() for r in rows]
    points = np.concatenate([points, points + (rng.random(points.shape) < 0.02).astype(np.uint16)])
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = jaccard_join.RTree(points, sizes)
    asked, found, bounds = tree.search_all(points, sizes, 80, lambda i, x: i != x)
    want = {(i, j): s for i in range(len(points)) for j, s in enumerate(np.minimum(points, points[i]).sum(axis=1, dtype=np.int64).tolist()) if i != j and s >= jaccard_join.needed(int(sizes[i]), int(sizes[j]), 80)}
    assert dict(zip(zip(asked.tolist(), found.tolist(), strict=True), bounds.tolist(), strict=True)) == want and len(want) == len(asked) > 100
