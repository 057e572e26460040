"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. A text is normalised as an identity-normalised
model asks (dummy prefix, spaces to U+2581), cut where a non-marker is followed by a marker (no piece of
the vocabulary spans such a place, which is checked when the model is loaded), and each distinct run is
merged once per worker by the agenda: the pair with the best score, leftmost first, is joined until no
adjacent pair is in the vocabulary. Symbols left over fall back to UTF-8 bytes.

Each run that the agenda segments is checked against the sentencepiece library in the same Arrow batch,
in both directions, and so is one whole text of each batch (`verify="runs"`); `verify="texts"` checks
every whole text. A difference raises: results are never silently replaced.

Defined cases: null text is the empty text; an empty text encodes to the begin and end ids alone and
decodes to the empty text; very long texts and runs are encoded whole; repeated rows give repeated
results; an empty table gives an empty result. Columns other than the id and text are not carried.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import Memo, map_arrow, slices

MARK = "▁"
RUN = re.compile(f"{MARK}+[^{MARK}]*")


class Agenda:
    """Encoder and decoder over one vocabulary. The library is used to read the model file and to check."""

    def __init__(self, model_path: str, most: int = 224 << 20):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in range(n)]
        self.text = [self.library.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if self.library.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i] and i not in self.byte_of}
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        utf8 = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if special[i] else self.text[i].replace(MARK, " ").encode() for i in range(n)]
        self.lengths = np.array([len(u) for u in utf8])
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.bytes = np.frombuffer(b"".join(utf8), dtype=np.uint8)
        #: Pairs of characters that some piece holds; no piece, so no merge, spans a place between any other two.
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        #: Run without its first marker, or part of a run, -> packed ids.
        self.memo, self.parts = Memo(most * 3 // 4), Memo(most // 4)
        if self.library.encode("a  b ", out_type=str) and self.library.decode(self.library.encode(" a  b ")) != " a  b ":
            raise ValueError("the model folds white space; only identity normalisation is supported")

    def merge(self, run: str) -> list[int]:
        """Ids of one normalised run."""
        symbols = list(run)
        n = len(symbols)
        get, push, pop = self.score.get, heapq.heappush, heapq.heappop
        pairs = [a + b for a, b in zip(symbols, symbols[1:], strict=False)]
        agenda = [(-found, i, pair) for i, (pair, found) in enumerate(zip(pairs, map(get, pairs), strict=True)) if found is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = pop(agenda)
            j = after[i]
            # Symbols only grow and are emptied when joined to the left: a stale pair no longer spells out here.
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                found = get(pair + symbols[j])
                if found is not None:
                    push(agenda, (-found, i, pair + symbols[j]))
            h = before[i]
            if h >= 0:
                found = get(symbols[h] + pair)
                if found is not None:
                    push(agenda, (-found, h, symbols[h] + pair))
        out: list[int] = []
        for s in symbols:
            if s:
                found = self.ids.get(s)
                out.extend([found] if found is not None else [self.of_byte[b] for b in s.encode()])
        return out

    def parted(self, run: str) -> list[str]:
        """The run (with its marker) cut where no piece of the vocabulary has the two neighbouring characters."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(map(str.__add__, run, run[1:]), 1) if pair not in inside]
        return [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True)] if cuts else [run]

    def learn(self, runs: list[str]) -> dict[str, bytes]:
        """Packed ids of runs (without their first marker), each checked against the library; they go into the memo."""
        expected = self.library.encode(runs, num_threads=1)
        parts, learned = self.parts, {}
        for run, want in zip(runs, expected, strict=True):
            packed = b""
            for part in self.parted(MARK + run):
                found = parts.get(part)
                if found is None:
                    ids = self.merge(part)
                    found = parts.keep(part, pack(f"<{len(ids)}I", *ids), 2 * len(part) + 4 * len(ids))
                packed += found
            # A lone marker is what follows a text's last space; alone, the library encodes "" to no ids.
            if packed != pack(f"<{len(want)}I", *want) and run:
                raise RuntimeError(f"agenda and library differ on {run[:80]!r}: {unpack(f'<{len(packed) // 4}I', packed)[:20]} {want[:20]}")
            learned[run] = self.memo.keep(run, packed, 2 * len(run) + len(packed))
        return learned

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """UTF-8 of each list of packed ids: pieces put together, byte pieces as bytes, the dummy prefix taken off."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        out = self.bytes[source].tobytes()
        last = np.cumsum([len(p) // 4 for p in packed]) - 1
        stops = ends[last].tolist() if len(packed) else []
        return [out[a:b][1:] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else []

    def runs(self, text: str) -> list[str]:
        """The runs of the normalised text, each without its first marker."""
        if not text:
            return []
        if self.cuts and text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        whole = MARK + text.replace(" ", MARK)
        return [r[1:] for r in RUN.findall(whole)] if self.cuts else [whole[1:]]

    def batch(self, texts: list[str], verify: str) -> tuple[list[bytes], list[bytes]]:
        """Packed ids (begin and end included) and decoded UTF-8 of each text."""
        begin, end = pack("<I", self.bos), pack("<I", self.eos)
        cut = [self.runs(t) for t in texts]
        hits = [list(map(self.memo.get, rs)) for rs in cut]
        missing = {r for rs, h in zip(cut, hits, strict=True) if None in h for r, x in zip(rs, h, strict=True) if x is None}
        if missing:
            learned = self.learn(list(missing))
            for k, (rs, h) in enumerate(zip(cut, hits, strict=True)):
                if None in h:
                    hits[k] = [learned[r] if x is None else x for r, x in zip(rs, h, strict=True)]
        ids = [begin + b"".join(h) + end for h in hits]
        decoded = self.decode(ids)
        for k in range(len(texts)) if verify == "texts" else [len(texts) // 2][: len(texts)]:
            own = list(unpack(f"<{len(ids[k]) // 4}I", ids[k]))
            if own[1:-1] != self.library.encode(texts[k]) or decoded[k].decode() != self.library.decode(own):
                raise RuntimeError(f"agenda and library differ on a text that begins {texts[k][:80]!r}")
        return ids, decoded


@lru_cache(maxsize=2)
def agenda(model_path: str) -> Agenda:
    """One per worker process and model, so that its memo serves all of the worker's tasks."""
    return Agenda(model_path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: str = "runs") -> DataFrame:
    """Per row: the id, `ids` (binary: little-endian unsigned 32-bit, begin and end included) and `decoded`
    (the text that those ids decode to)."""

    def codec(batch: pa.RecordBatch):
        for part in slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, decoded = agenda(model_path).batch(texts, verify)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["id", "ids", "decoded"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_arrow(narrow, codec, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: n_tokens and the digests of what encode_decode() returned."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
