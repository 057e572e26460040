"""A Katz back-off bigram model: training, partitioned model tables and scores of whole documents.

Words are lower-cased (A-Z); an end token closes each document and a start token stands before its first
word. Probability of w after h, evaluated recursively:

  seen pair      d(c(h,w)) c(h,w) / (c(h) + 1)
  unseen pair    alpha(h) p(w),  alpha(h) = (1 - sum of the above over seen w) / (1 - sum of p(w) over seen w)
  p(known word)  d1(c(w)) c(w) / N;  p(unknown word) = what is left of 1

d, d1: Good-Turing discounts by Katz's formula for counts up to 5 (where counts of counts do not give
ratios between 0 and 1, absolute discounting), 1 above. The +1 leaves every history some mass, and alpha
makes each history sum to exactly 1 over the known words and one unknown word. All statistics come from
all training documents.

Tables: the pairs with their counts (order2) and the words with their counts, discounted probabilities and
back-off weights (order1) are stored in Parquet, partitioned by order, as compressed blobs of a bucket each;
ngrams() reads them as rows, log p(w|h) = log10(d c(h,w)) - log10(c(h) + 1). The order is 2.

Scale: a row of a shuffle is a compressed blob of a block of documents and a bucket of words (see
postings.py), not a token. Pairs are dealt by their second word, those of the few very frequent words by
both, so no word is one task; the bucket that makes a pair's entry in the table also knows its documents, adds
up what can be known there (counts of 1 to 5 stay symbolic until the discounts are known), and sends sums per
document to the block. Pairs unseen in training go on to their history's bucket, where the table of words gives
their back-off weight. The most frequent words, 65,536 of them in equal shares of
the buckets, are sent as numbers.

Words are 64-bit hashes (xxh3); two words with equal hashes would be taken for one.

Defined cases: null and empty texts are the end token alone; very long texts are read whole; repeated rows
and ids are documents of their own; null ids count as the empty id for the split; without training
documents every probability is that of the one unknown word (1); words with equal counts are told apart by their hashes; columns
beside id and text, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import WordIds, held_out, mix, partitions, save, slices, texts_of
from credenza.llm.postings import block_number, packed, unpacked

START, END = 0x9D1F3C55A7B2E641, 0x51E2A7C93B4D8F07
K = 5
#: Bytes of text in a block, and training tokens to a bucket beyond which there are more buckets than shuffle partitions.
SLICE, BUCKET_TOKENS = 6 << 20, 4_000_000
#: So many of the most frequent words are sent as numbers instead of 64-bit ids.
COMMON = 65_536
OUT = "kind string, key bigint, blob binary"


def discounts(counts: list[int]) -> list[float]:
    """d for counts 1 to K, from counts of counts 1 to K + 1."""
    n = [0, *counts]
    first = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    absolute = [(r - first * 0.999) / r for r in range(1, K + 1)]
    if min(n[1 : K + 2]) <= 0:
        return absolute
    tail = (K + 1) * n[K + 1] / n[1]
    if tail >= 1:
        return absolute
    katz = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, K + 1)]
    return katz if all(0 < d < 1 for d in katz) else absolute


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(buckets: int):
    """(text) of training documents to (bucket, blob of word ids and counts)."""

    def run(batches):
        ids = WordIds()
        for batch in batches:
            for part in slices(batch, most=SLICE):
                names, n = np.unique(tokens_of(texts_of(part), ids)[0], return_counts=True)
                bucket = (names % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                rows = [(b, packed(names[own], n[own].astype(np.uint32))) for b, x, y in zip(range(buckets), edges, edges[1:], strict=False) if x < y for own in [order[x:y]]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return run


WORD_TABLE = "bucket int, blob binary, tokens bigint, types bigint, counts array<bigint>, top array<struct<id: bigint, n: bigint>>"


def sum_words(most: int):
    """A bucket's blobs to one: its word table, with totals, counts of counts and its most frequent words."""
    return lambda table: _sum_words(table, most)


def _sum_words(table: pa.Table, most: int) -> pa.Table:
    parts = [unpacked(b) for b in table.column("blob").to_pylist()]
    names, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
    top = np.argsort(-n, kind="stable")[:most]
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "blob": pa.array([packed(names, n.astype(np.uint64))], pa.binary()),
        "tokens": pa.array([int(n.sum())], pa.int64()), "types": pa.array([len(n)], pa.int64()),
        "counts": pa.array([[int((n == r).sum()) for r in range(1, K + 2)]], pa.list_(pa.int64())),
        "top": pa.array([[{"id": int(names[i].view(np.int64)), "n": int(n[i])} for i in top]], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))),
    })


def word_blob(names: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word ids as numbers in the table of common words where they are in it, and as ids where they are not."""
    at = np.minimum(np.searchsorted(common, names), max(0, len(common) - 1))
    found = common[at] == names if len(common) else np.zeros(len(names), dtype=bool)
    return at[found].astype(np.uint16 if len(common) <= 65536 else np.uint32), names[~found]


def words_in(numbers: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The sorted word ids of word_blob()."""
    return np.sort(np.concatenate([common[numbers], rest])) if len(common) else rest


def pairs_to_blobs(buckets: int, frequent: np.ndarray, common: np.ndarray):
    """(id, text, train) to (bucket, block, head, blob): a block's heading, and its word pairs with their documents by bucket."""
    salt = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        ids, counter = WordIds(), [0]
        for batch in batches:
            for part in slices(batch, most=SLICE):
                texts, train = texts_of(part), np.array(part.column("train").to_pylist(), dtype=bool)
                n, block = len(texts), block_number(counter)
                w, sizes = tokens_of(texts, ids)
                heading = pa.RecordBatch.from_arrays([part.column("id"), pa.array(~train), pa.array(sizes, pa.int64())], ["id", "held_out", "n_tokens"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, heading.schema) as writer:
                    writer.write_batch(heading)
                rows = [(block % buckets, block, True, sink.getvalue().to_pybytes())]
                del texts
                # The history of a document's first word is the start token; words and documents as small numbers.
                names, local = np.unique(np.append(w, np.uint64(START)), return_inverse=True)
                del w
                history = np.roll(local[:-1], 1)
                history[np.cumsum(sizes) - sizes] = local[-1]
                bits_d, bits_w = max(1, int(n - 1).bit_length()), max(1, int(len(names) - 1).bit_length())
                key = (local[:-1] << (bits_w + bits_d)) | (history << bits_d) | np.repeat(np.arange(n), sizes)
                del local, history
                key, f = np.unique(key, return_counts=True)
                f = f.astype(np.uint16 if f.max() < 65536 else np.uint32)
                pair = key >> bits_d
                w = names[pair >> bits_w]
                dealt = np.where(np.isin(w, frequent), mix(w + names[pair & ((1 << bits_w) - 1)] * salt), w) % np.uint64(buckets)
                dealt = dealt.astype(np.uint16 if buckets < 65536 else np.uint32)
                del w, pair
                order = np.argsort(dealt, kind="stable")
                key, f = key[order], f[order]
                edges = np.searchsorted(dealt[order], np.arange(buckets + 1))
                del order, dealt
                for b, x, y in zip(range(buckets), edges.tolist(), edges[1:].tolist(), strict=False):
                    if x == y:
                        continue
                    d = (key[x:y] & ((1 << bits_d) - 1)).astype(np.uint16 if n < 65536 else np.uint32)
                    pair = key[x:y] >> bits_d
                    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                    used_w, at_w = np.unique(pair[first] >> bits_w, return_inverse=True)
                    used_h, at_h = np.unique(pair[first] & ((1 << bits_w) - 1), return_inverse=True)
                    rows.append((b, block, False, packed(
                        *word_blob(names[used_w], common), np.bincount(at_w).astype(np.uint32), *word_blob(names[used_h], common), at_h.astype(np.uint16 if len(used_h) < 65536 else np.uint32),
                        np.minimum(np.diff(np.r_[first, y - x]), 2**32 - 1).astype(np.uint32), d, f[x:y], np.packbits(train[d]),
                    )))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "block", "head", "blob"])

    return run


def tokens_of(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word ids, each text closed by the end token, and the number of tokens of each."""
    parts, sizes, end = [], [], np.array([END], dtype=np.uint64)
    for text in texts:
        found = ids.array(words_of(text))
        parts += [found, end]
        sizes.append(len(found) + 1)
    return np.concatenate(parts), np.array(sizes, dtype=np.int64)


def lookup(names: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Count of each wanted id in a sorted table, 0 where absent."""
    if not len(names):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, counts[at].astype(np.int64), 0)


def unigram_log(c: np.ndarray, total: int, d: list[float], unknown: float) -> np.ndarray:
    """log10 p(w) by the word's count."""
    factor = np.array([1.0, *d])
    small = np.where(c <= K, factor[np.minimum(c, K)], 1.0)
    return np.log10(np.where(c > 0, small * c / max(1, total), unknown))


def per_document(block: np.ndarray, doc: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """Sums of the values per (block, document), one blob per block. Blocks are numbered anew, as their own numbers and a
    document's do not fit into one integer."""
    blocks, at = np.unique(block, return_inverse=True)
    names, where = np.unique((at << 32) | doc.astype(np.int64), return_inverse=True)
    sums = np.bincount(where, weights=values, minlength=len(names))
    edges = np.searchsorted(names, np.arange(len(blocks) + 1) << 32).tolist()
    return [(int(blocks[i]), packed((names[a:b] & 0xFFFFFFFF).astype(np.uint32), sums[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


#: Kinds of rows in the model tables: those of the model (its n-grams, by their order) and those of the documents that are scored.
WORDS, PAIRS, HEADING, DOCUMENTS, HISTORIES, UNSEEN, COUNTS, FREQUENT = "order1", "order2", "heading", "documents", "histories", "unseen", "counts", "frequent"


def as_rows(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"kind": pa.array(columns[0], pa.string()), "key": pa.array(columns[1], pa.int64()), "blob": pa.array(columns[2], pa.binary())})


def count_pairs(buckets: int, frequent: dict[int, int], common: np.ndarray, total: int, d1: list[float], unknown: float):
    """A bucket's pairs and word table to rows of the model tables (see OUT)."""

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        rows: list[tuple[str, int, bytes]] = []
        heads, blocks, blobs = (pairs.column(c).to_pylist() for c in ("head", "block", "blob"))
        rows.extend((HEADING, block, blob) for head, block, blob in zip(heads, blocks, blobs, strict=True) if head)
        pairs_in = [(block, blob) for head, block, blob in zip(heads, blocks, blobs, strict=True) if not head]
        if pairs_in:
            bucket = int(pairs.column("bucket")[0].as_py())
            rows.extend(_count_pairs(bucket, [b for _, b in pairs_in], np.array([b for b, _ in pairs_in], dtype=np.int64), words, buckets, frequent, common, total, d1, unknown))
        return as_rows(rows)

    return run


#: A bucket's pairs are worked on in this many parts, one after the other, to bound a worker's memory.
PARTS = 4


def _part_of(blob: bytes, number: int, buckets: int, common: np.ndarray) -> list[np.ndarray]:
    """The arrays of a blob for the pairs whose second word falls into one part; documents' train flags as booleans."""
    numbers_w, rest_w, n_w, numbers_h, rest_h, at_h, runs, doc, f, bits = unpacked(blob)
    used_w, used_h = words_in(numbers_w, rest_w, common), words_in(numbers_h, rest_h, common)
    own = (used_w // np.uint64(buckets)) % np.uint64(PARTS) == np.uint64(number)
    pairs = np.repeat(own, n_w)
    entries = np.repeat(pairs, runs)
    return [np.repeat(used_w[own], n_w[own]), used_h[at_h[pairs]], runs[pairs].astype(np.int64), doc[entries].astype(np.uint32), f[entries].astype(np.uint32), np.unpackbits(bits, count=len(doc)).astype(bool)[entries]]


def _count_pairs(bucket, blobs, blocks, words, buckets, frequent, common, total, d1, unknown):
    """blocks: the block of each blob; within the bucket a block goes by its place in that list."""
    names, counts = unpacked(words.column("blob")[0].as_py()) if words.num_rows else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    hot = np.array(sorted(frequent), dtype=np.uint64)
    hot_counts = np.array([frequent[int(x)] for x in hot], dtype=np.int64)
    discount1 = np.array([0.0, *d1])
    documents, histories, n_counts = [], [], np.zeros(K + 1, dtype=np.int64)
    for number in range(PARTS):
        parts = [_part_of(b, number, buckets, common) for b in blobs]
        w, h, runs, doc, f, train = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = np.repeat(np.arange(len(blocks)), [len(p[3]) for p in parts])
        del parts
        if not len(w):
            continue
        # One entry per distinct pair; `each` is the pair of each (pair, document).
        in_training = np.add.reduceat(f * train, np.cumsum(runs) - runs).astype(np.int64)
        key = mix(w ^ mix(h))
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
        c_distinct = np.add.reduceat(in_training[order], first)
        c_pair = np.empty(len(w), dtype=np.int64)
        c_pair[order] = np.repeat(c_distinct, np.diff(np.r_[first, len(order)]))
        one = order[first]
        del key, order, first, c_distinct, in_training, train
        c_word = lookup(names, counts, w)
        if len(hot):
            c_word = np.where(np.isin(w, hot), lookup(hot, hot_counts, w), c_word)
        # What each token adds, per pair: its own probability, less what it takes as the history of the next one.
        own = np.where(c_pair > K, np.log10(np.maximum(c_pair, 1)), 0.0) + np.where(c_pair == 0, unigram_log(c_word, total, d1, unknown), 0.0)
        own -= np.where(w == np.uint64(END), 0.0, np.log10(c_word + 1.0))
        each = np.repeat(np.arange(len(w), dtype=np.int32), runs)
        of, where = np.unique((block << 32) | doc, return_inverse=True)
        small = np.where(c_pair <= K, c_pair, 0).astype(np.int8)[each]
        sums = [np.bincount(where, weights=np.log10(c_word + 1.0)[each] * f, minlength=len(of)), np.bincount(where, weights=f * (c_word > 0)[each], minlength=len(of)).astype(np.uint32), np.bincount(where, weights=own[each] * f, minlength=len(of))]
        sums += [np.bincount(where, weights=f * (small == r), minlength=len(of)).astype(np.uint32) for r in range(1, K + 1)]
        documents.append((of, sums))
        del where, small, own
        # Pairs unseen in training, to their histories (frequent ones by block as well).
        lost = np.flatnonzero((c_pair == 0)[each])
        lh, lb, ld, lf = h[each[lost]], blocks[block[lost]], doc[lost], f[lost]
        del each, block, doc, f, lost
        to = (np.where(np.isin(lh, hot), mix(lh + lb.astype(np.uint64)), lh) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ld, lb, to))
        edges = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
        for b, x, y in zip(range(buckets), edges, edges[1:], strict=False):
            if x < y:
                part = order[x:y]
                code, block_of = np.unique(lb[part], return_inverse=True)
                yield UNSEEN, b, packed(lh[part], code, block_of.astype(np.uint32), ld[part], lf[part])
        # The pairs seen in training: the model's table, and sums per history over them.
        seen = one[c_pair[one] > 0]
        seen = seen[np.lexsort((h[seen], w[seen]))]
        c, cw = c_pair[seen], c_word[seen]
        used, n_used = np.unique(w[seen], return_counts=True)
        yield PAIRS, bucket, packed(used, n_used.astype(np.uint32), *_numbered(h[seen], common), _narrow(c))
        of_h, where = np.unique(h[seen], return_inverse=True)
        whole = [np.bincount(where, weights=x, minlength=len(of_h)) for x in (np.where(c > K, c, 0), *[c == r for r in range(1, K + 1)])]
        histories.append((of_h, [*whole, np.bincount(where, weights=np.where(cw <= K, discount1[np.minimum(cw, K)], 1.0) * cw, minlength=len(of_h))]))
        n_counts += np.array([int((c == r).sum()) for r in range(1, K + 2)], dtype=np.int64)
    if documents:
        of, sums = _added(documents)
        edges = np.searchsorted(of, np.arange(len(blocks) + 1) << 32).tolist()
        for i, x, y in zip(range(len(blocks)), edges, edges[1:], strict=False):
            if x < y:
                yield DOCUMENTS, int(blocks[i]), packed((of[x:y] & 0xFFFFFFFF).astype(np.uint32), *[s[x:y] if i in (0, 2) else s[x:y].astype(np.uint32) for i, s in enumerate(sums)])
        of_h, sums = _added(histories)
        to = np.where(np.isin(of_h, hot), buckets, (of_h % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(buckets + 2)).tolist()
        for b, x, y in zip(range(buckets + 1), edges, edges[1:], strict=False):
            if x < y:
                part = order[x:y]
                yield (FREQUENT if b == buckets else HISTORIES), b, packed(of_h[part], *[_narrow(s[part]) for s in sums[:-1]], sums[-1][part])
    yield COUNTS, 0, packed(n_counts)


def _numbered(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids in any order: a number in the table of common words each (its length for the others), and the others' ids."""
    at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    found = common[at] == words if len(common) else np.zeros(len(words), dtype=bool)
    return np.where(found, at, len(common)).astype(np.uint32), words[~found]


def _words_of(numbers: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The word ids of _numbered()."""
    out = np.append(common, np.uint64(0))[numbers]
    out[numbers == len(common)] = rest
    return out


def _narrow(sums: np.ndarray) -> np.ndarray:
    return sums.astype(np.uint32 if not len(sums) or sums.max() < 2**32 else np.uint64)


def _added(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the parts' columns per key."""
    names, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, [np.bincount(where, weights=np.concatenate([p[1][i] for p in parts]), minlength=len(names)) for i in range(len(parts[0][1]))]


def alpha_log(sums: list[np.ndarray], c_history: np.ndarray, d: list[float], total: int) -> np.ndarray:
    """log10 of alpha(h) (c(h) + 1): what an unseen pair adds beside p(w), given that -log10(c(h) + 1) was added already."""
    big, *rest = [s.astype(np.float64) for s in sums]
    mass = big + sum(n * r * x for r, (n, x) in enumerate(zip(rest[:K], d, strict=True), 1))
    left = np.maximum(c_history + 1.0 - mass, 1e-12)
    return np.log10(left) - np.log10(np.maximum(1.0 - rest[K] / max(1, total), 1e-12))


def back_off(frequent: dict[int, float], d: list[float], d1: list[float], total: int):
    """Rows of histories and unseen pairs of a bucket, and its word table, to the model's table of words (with their
    back-off weights) and sums per document of what the unseen pairs take from it."""

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        kinds, blobs = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
        out: list[tuple[str, int, bytes]] = []
        names, counts = unpacked(words.column("blob")[0].as_py()) if words.num_rows else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        counts = counts.astype(np.int64)
        sums = [np.zeros(len(names)) for _ in range(K + 2)]
        for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == HISTORIES):
            of_h, *more = unpacked(blob)
            # Every history but the start token, which is a frequent one, is a word of this bucket.
            at = np.searchsorted(names, of_h)
            for total_of, x in zip(sums, more, strict=True):
                total_of[at] += x
        weights = alpha_log(sums, counts, d, total)
        hot = np.array(sorted(frequent), dtype=np.uint64)
        hot_weights = np.array([frequent[int(x)] for x in hot])
        if len(names):
            at = np.minimum(np.searchsorted(hot, names), max(0, len(hot) - 1))
            weights = np.where(hot[at] == names, hot_weights[at], weights) if len(hot) else weights
            weights = np.where(names == np.uint64(END), 0.0, weights)
            out.append((WORDS, int(words.column("bucket")[0].as_py()), packed(names, _narrow(counts), unigram_log(counts, total, d1, 1.0), weights - np.log10(counts + 1.0))))
        asked = []
        for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == UNSEEN):
            h, code, block_of, doc, f = unpacked(blob)
            value = np.zeros(len(h))
            for table, logs in ((names, weights), (hot, hot_weights)):
                if len(table):
                    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    value = np.where(table[at] == h, logs[at], value)
            asked.append((code[block_of], doc, value * f))
        if asked:
            out.extend((UNSEEN, *x) for x in per_document(*map(np.concatenate, zip(*asked, strict=True))))
        return as_rows(out)

    return run


def finish(d: list[float], train_docs: int, total: int, types: int):
    """Heading and sums of a block to one row per document."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows = pa.ipc.open_stream(next(b for k, b in zip(kinds, blobs, strict=True) if k == HEADING)).read_all()
        n = rows.num_rows
        base, score, known = np.zeros(n), np.full(n, -math.log10(train_docs + 1.0)), np.zeros(n, dtype=np.int64)
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind == DOCUMENTS:
                doc, b, k, own, *ones = unpacked(blob)
                base[doc] += b
                known[doc] += k.astype(np.int64)
                score[doc] += own + sum(x * math.log10(r * d[r - 1]) for r, x in enumerate(ones, 1))
            elif kind == UNSEEN:
                doc, more = unpacked(blob)
                score[doc] += more
        tokens = rows.column("n_tokens").to_numpy()
        base -= tokens * math.log10(total + types + 1)
        return pa.table({"id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": rows.column("n_tokens"), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def fit(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scores, see score(), and the model, see ngrams(): rows of the tables order1 and order2, with the parameters beside them."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(id_col, modulus, remainder)).alias("train"))
    kind = narrow.schema["id"].dataType.simpleString()
    training = narrow.filter("train").select("text")
    n_bytes, train_docs = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # More buckets than shuffle partitions where a bucket would not fit into a worker; a token has 5 bytes at least as a rule.
    buckets = max(buckets, n_bytes // (5 * BUCKET_TOKENS))
    counted = training.mapInArrow(count_words(buckets), "bucket int, blob binary")
    words = save(counted.groupBy("bucket").applyInArrow(sum_words(max(16, COMMON // buckets)), WORD_TABLE), "words")
    sums = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), *[F.coalesce(F.sum(F.get("counts", F.lit(r))), F.lit(0)) for r in range(K + 1)]).first()
    total, types, counts = int(sums[0]), int(sums[1]), [int(x) for x in sums[2:]]
    d1 = discounts(counts)
    unknown = sum(n * (1 - x) * r for r, (n, x) in enumerate(zip(counts[:K], d1, strict=True), 1)) / total if total else 1.0
    unknown = unknown or 1.0 / (total + 1)
    top = words.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "id").limit(COMMON).collect()
    common = np.sort(np.array([r["id"] for r in top], dtype=np.int64).view(np.uint64))
    # At most 4 x buckets words hold a quarter of a bucket's share each.
    frequent = {int(r["id"]) & 0xFFFFFFFFFFFFFFFF: int(r["n"]) for r in top if r["n"] > total / (4 * buckets)}
    hot = {**frequent, START: train_docs}
    blobs = narrow.mapInArrow(pairs_to_blobs(buckets, np.array(sorted(frequent), dtype=np.uint64), common), "bucket int, block bigint, head boolean, blob binary")
    tables = save(blobs.groupBy("bucket").cogroup(words.select("bucket", "blob").groupBy("bucket")).applyInArrow(count_pairs(buckets, hot, common, total, d1, unknown), OUT), "katz", partition_by=("kind",))
    pair_counts = [sum(x) for x in zip(*(unpacked(r[0])[0].tolist() for r in tables.filter(F.col("kind") == COUNTS).select("blob").collect()), strict=True)] or [0] * (K + 1)
    d = discounts(pair_counts)
    found = tables.filter(F.col("kind") == FREQUENT).select("blob").mapInArrow(_long_histories, "id bigint, sums array<double>")
    rows = found.groupBy("id").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(K + 2)]).collect()
    frequent_alpha = {int(r["id"]) & 0xFFFFFFFFFFFFFFFF: float(alpha_log([np.array([r[f"s{i}"]]) for i in range(K + 2)], np.array([hot[int(r["id"]) & 0xFFFFFFFFFFFFFFFF]]), d, total)[0]) for r in rows}
    to_histories = tables.filter(F.col("kind").isin(HISTORIES, UNSEEN))
    backed = to_histories.groupBy(F.col("key").cast("int").alias("bucket")).cogroup(words.select("bucket", "blob").groupBy("bucket")).applyInArrow(back_off(frequent_alpha, d, d1, total), OUT)
    backed = save(backed, "katz", partition_by=("kind",))
    per_block = tables.filter(F.col("kind").isin(HEADING, DOCUMENTS)).unionByName(backed.filter(F.col("kind") == UNSEEN)).select("kind", "key", "blob")
    out = per_block.groupBy("key").applyInArrow(finish(d, train_docs, total, types), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    scores = out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    start = packed(np.array([START], dtype=np.uint64), np.array([train_docs]), np.array([-np.inf]), np.array([frequent_alpha.get(START, 0.0) - math.log10(train_docs + 1.0)]))
    other = spark.createDataFrame([(WORDS, -1, bytearray(start)), ("common", 0, bytearray(packed(common))), ("parameters", 0, bytearray(packed(np.array([unknown, *d]))))], OUT)
    model = backed.filter(F.col("kind") == WORDS).unionByName(tables.filter(F.col("kind") == PAIRS)).select("kind", "key", "blob").unionByName(other)
    return scores, model


def ngrams(model: DataFrame) -> DataFrame:
    """The model's n-grams, one a row: order_n, history and word (64-bit word ids; history null at order 1), n (the
    count), log_p (discounted) and log_bow (of the word as a history; null at order 2). The row of order 0 has the
    probability of an unknown word."""
    common = unpacked(model.filter(F.col("kind") == "common").first()["blob"])[0]
    unknown, *d = unpacked(model.filter(F.col("kind") == "parameters").first()["blob"])[0].tolist()
    flat = model.filter(F.col("kind").isin(WORDS, PAIRS)).select("kind", "blob").mapInArrow(_flat(common, d), "order_n int, history bigint, word bigint, n bigint, log_p double, log_bow double")
    histories = flat.filter("order_n = 1").select(F.col("word").alias("h"), F.col("n").alias("n_h"))
    pairs = flat.filter("order_n = 2").join(histories, F.col("history") == F.col("h")).withColumn("log_p", F.col("log_p") - F.log10(F.col("n_h") + 1)).drop("h", "n_h")
    lowest = model.sparkSession.createDataFrame([(0, None, None, 0, math.log10(unknown), None)], flat.schema)
    return flat.filter("order_n = 1").unionByName(pairs).unionByName(lowest)


def _flat(common: np.ndarray, d: list[float]):
    """Blobs of the model to its n-grams; log_p of a pair still lacks its history's count."""
    factor = np.array([1.0, *d])

    def run(batches):
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == WORDS:
                    word, n, log_p, bow = unpacked(blob)
                    columns = [1, None, word, n, log_p, bow]
                else:
                    used, n_used, numbers, rest, n = unpacked(blob)
                    n = n.astype(np.int64)
                    columns = [2, _words_of(numbers, rest, common), np.repeat(used, n_used), n, np.log10(np.where(n <= K, factor[np.minimum(n, K)], 1.0) * n), None]
                size = len(columns[3])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                arrays = [pa.nulls(size, k) if c is None else pa.array(np.full(size, c), k) if isinstance(c, int) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["order_n", "history", "word", "n", "log_p", "log_bow"])

    return run


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10 of
    the model's probability of the text and its end). Rows whose crc32(id) mod modulus is remainder are not learned from."""
    return fit(docs, modulus, remainder, id_col, text_col)[0]


def _long_histories(batches):
    for batch in batches:
        ids, sums = [], []
        for blob in batch.column("blob").to_pylist():
            names, *columns = unpacked(blob)
            ids.extend(names.view(np.int64).tolist())
            sums.extend(np.array([c.astype(np.float64) for c in columns]).T.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["id", "sums"])
