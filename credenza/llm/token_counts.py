"""Token counts per document without materialising ids.

Documents are cut into the byte-level pre-tokens of the tokenizer and counted per document; each distinct
pre-token of a bucket is counted in pieces once, by the tokenizers library, and joined to the per-document
frequencies in that bucket; the products are summed per document (see postings.py for the shuffle).

Cutting: a text whose spaces all follow a non-space character is split at them, which are then always
pre-token boundaries, and each distinct split is cut by the pattern once per worker; other texts are cut
by the pattern whole. The special string is cut out first and counts as one token, as the library's default has it.

Defined cases: null text is the empty text, with 0 bytes and 0 tokens; very long texts are counted whole;
repeated rows (ids too) and null ids keep a result each; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import Memo, partitions, slices
from credenza.llm.postings import block_number, counted, dealt, packed, unpacked

#: The byte-level pre-token pattern (white space by its Unicode property) and those characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


class Cutter:
    """Pre-tokens of texts; special strings are kept whole."""

    def __init__(self, path: str, most: int = 96 << 20):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or model["normalizer"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        self.find = regex.compile(PATTERN).findall
        special = [t["content"] for t in model["added_tokens"]]
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.memo = Memo(most)

    def pretokens(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            parts = self.cut_special(text)
            return list(itertools.chain.from_iterable([p] if i % 2 else self.find(p) for i, p in enumerate(parts)))
        return self.find(text)

    def splits(self, text: str) -> bool:
        """Whether every space of the text is a pre-token boundary."""
        return not any(s in text for s in self.special) and text[:1] != " " and not any(c + " " in text for c in SPACES)

    def block(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of the texts, and (term, document, frequency) sorted by term."""
        spaced: dict[str, int] = {}
        whole: dict[str, int] = {}
        of_spaced, of_whole = [], []
        for text in texts:
            if not text:
                of_spaced.append(())
                of_whole.append(())
            elif self.splits(text):
                head, *rest = text.split(" ")
                of_spaced.append([spaced.setdefault(w, len(spaced)) for w in rest])
                of_whole.append([whole.setdefault(t, len(whole)) for t in self.pretokens(head)])
            else:
                of_spaced.append(())
                of_whole.append([whole.setdefault(t, len(whole)) for t in self.pretokens(text)])
        n = len(texts)

        def pairs(lists):
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=n)
            flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
            return counted(flat, np.repeat(np.arange(n), sizes), None, n)

        s_term, s_doc, s_n = pairs(of_spaced)
        w_term, w_doc, w_n = pairs(of_whole)
        sizes, flat = np.empty(len(spaced), dtype=np.int64), []
        for i, w in enumerate(spaced):
            found = self.memo.get(w)
            if found is None:
                found = self.memo.keep(w, tuple(self.find(" " + w)), 4 * len(w) + 100)
            sizes[i] = len(found)
            flat.extend([whole.setdefault(t, len(whole)) for t in found])
        starts = np.cumsum(sizes) - sizes
        reps = sizes[s_term]
        within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        terms = np.array(flat, dtype=np.int64)[np.repeat(starts[s_term], reps) + within] if flat else np.empty(0, dtype=np.int64)
        t, d, f = counted(np.r_[terms, w_term], np.r_[np.repeat(s_doc, reps), w_doc], np.r_[np.repeat(s_n, reps), w_n], n)
        return list(whole), t, d, f


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def to_blobs(path: str, buckets: int):
    """Batches of (id, text) to rows (bucket, block, head, blob): a block's heading and its postings by bucket."""
    import xxhash

    def run(batches):
        counter = [0]
        for batch in batches:
            for part in slices(batch, most=16 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                block = block_number(counter)
                terms, t, d, f = cutter(path).block(texts)
                raw = [x.encode() for x in terms]
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw))
                bucket = dealt(hashes, np.bincount(t, minlength=len(raw)), len(texts), block, buckets)
                heading = pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x.encode()) for x in texts], pa.int64())], ["id", "n_bytes"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, heading.schema) as writer:
                    writer.write_batch(heading)
                rows = [(block % buckets, block, True, sink.getvalue().to_pybytes())]
                order = np.argsort(bucket[t], kind="stable") if len(t) else t
                t, d, f = t[order], d[order], f[order]
                edges = np.searchsorted(bucket[t], np.arange(buckets + 1))
                for b in range(buckets):
                    x, y = edges[b], edges[b + 1]
                    if x == y:
                        continue
                    own, first = np.unique(t[x:y], return_index=True)
                    names = [raw[i] for i in own]
                    rows.append((b, block, False, packed(b"".join(names), np.fromiter(map(len, names), dtype=np.uint32, count=len(names)), np.diff(np.r_[first, y - x]).astype(np.uint32), d[x:y].astype(np.uint32), f[x:y].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "block", "head", "blob"])

    return run


BLOBS = "bucket int, block bigint, head boolean, blob binary"


def count_bucket(path: str):
    """The blobs of a bucket, one after the other, to per-document sums of pieces, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, pieces = tokenizer(path), Memo(64 << 20)
        for batch in batches:
            blocks, heads, blobs = (batch.column(c).to_pylist() for c in ("block", "head", "blob"))
            out = [blob if head else packed(*sums_of(blob, library, pieces)) for head, blob in zip(heads, blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(heads, pa.bool_()), pa.array(out, pa.binary())], ["block", "head", "blob"])

    return run


def sums_of(blob: bytes, library, pieces: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a blob of postings and their sums of pieces."""
    names, sizes, runs, docs, freq = unpacked(blob)
    ends = np.cumsum(sizes).tolist()
    own = [names[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    counts = list(map(pieces.get, own))
    new = [i for i, n in enumerate(counts) if n is None]
    for i, encoded in zip(new, library.encode_batch_fast([own[i].decode() for i in new], add_special_tokens=False), strict=True):
        counts[i] = pieces.keep(own[i], len(encoded.ids), len(own[i]))
    each = np.repeat(np.array(counts, dtype=np.int64), runs)
    present, where = np.unique(docs, return_inverse=True)
    return present.astype(np.uint32), np.bincount(where, weights=each * freq.astype(np.int64)).astype(np.uint64)


def sum_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's heading and sums to one row per document."""
    rows, sums = None, []
    for batch in batches:
        for head, blob in zip(batch.column("head").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if head:
                rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
            else:
                sums.append(unpacked(blob))
    total = np.zeros(rows.num_rows, dtype=np.int64)
    for docs, n in sums:
        total[docs] += n.astype(np.int64)
    yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns] + [pa.array(total, pa.int64())], ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    blobs = narrow.mapInArrow(to_blobs(path, partitions(spark)), BLOBS)
    sums = blobs.groupBy("bucket").applyInArrow(count_bucket(path), "block bigint, head boolean, blob binary")
    counts = sums.groupBy("block").applyInArrow(sum_block, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
