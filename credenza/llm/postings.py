"""Blocks of documents as term postings, dealt to buckets of terms and summed back per document.

A block is the documents of one slice of an Arrow batch. Its terms are counted per document with numpy and
sent as one compressed blob per (block, bucket of terms); a reducer sees each bucket's blobs, decides a
value per term once, and sends per-document sums back to the block. So a shuffle row is a blob, not a
token, and identical terms cost one entry per block and document.

Skew: a term that is in many of a block's documents is dealt by block as well as by term, so that the
postings of a very frequent term are spread over all buckets.
"""

from __future__ import annotations

import numpy as np
import zstandard

HEAVY = 0.125


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (and byte strings) as one zstd-compressed blob; see unpacked()."""
    parts = []
    for a in arrays:
        kind, raw = (b"b", a) if isinstance(a, bytes) else (a.dtype.char.encode(), np.ascontiguousarray(a).tobytes())
        parts.append(kind + len(raw).to_bytes(8, "little") + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind, n = raw[at : at + 1], int.from_bytes(raw[at + 1 : at + 9], "little")
        body = raw[at + 9 : at + 9 + n]
        out.append(body if kind == b"b" else np.frombuffer(body, dtype=kind.decode()))
        at += 9 + n
    return out


def block_number(counter: list[int]) -> int:
    """A number for the next block of this task: the same whenever the task is run again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    counter[0] += 1
    return ((context.partitionId() if context else 0) << 24) + counter[0]


def counted(terms: np.ndarray, docs: np.ndarray, weights: np.ndarray | None, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and summed weight of each distinct (term, document) pair, sorted by term, then document."""
    key = terms.astype(np.int64) * max(1, n_docs) + docs
    if weights is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        n = np.add.reduceat(weights[order], first) if len(key) else weights
        key = key[first]
    return key // max(1, n_docs), key % max(1, n_docs), n


def dealt(hashes: np.ndarray, n_in_docs: np.ndarray, n_docs: int, block: int, buckets: int) -> np.ndarray:
    """The bucket of each of a block's terms."""
    heavy = (n_in_docs >= 64) & (n_in_docs >= HEAVY * n_docs)
    salted = hashes + np.uint64(block) * heavy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (salted % np.uint64(buckets)).astype(np.int64)
