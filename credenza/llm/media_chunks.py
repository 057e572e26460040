"""Media columns by content-defined chunking.

A payload becomes a media file (8-bit mono WAV, one sample per byte). The file is cut where a rolling gear
hash of the last 32 bytes meets a mask, within least and greatest chunk sizes; a chunk is named by its
SHA-256. The chunk store keeps each distinct chunk once (zstd-compressed), and a media is the ordered list
of its chunk names. Reading a media joins its list to the store, puts the chunks together in order,
verifies every chunk name and the digest of the whole file, and decodes the samples.

Scale: chunk bytes move once to be deduplicated by name (one shuffle) into a store that is bucketed by
name, so reading it back needs no second shuffle of the store; only the bytes of media of two or more
chunks are shuffled again, by media. Lists, and media that occur more than once, are kept once per
distinct media and joined to the documents by media name, a join that adaptive execution can split.

Defined cases: null text is the empty text, which is padded to one block of 576; payloads of any length are
stored whole; repeated rows and equal texts get equal values; an empty table gives an empty result; other
columns are not carried. A chunk or file whose digest differs raises.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import partitions, release, save, shared_dir, slices, texts_of

BLOCK, PAD = 576, 255
LEAST, MASK_BITS, GREATEST = 2048, 13, 65536
#: The gear: one 32-bit word per byte value, by rule (the first four bytes of the SHA-256 of the byte).
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    """Text padded with byte 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """An 8-bit mono PCM file. The payload is a multiple of 576, so no pad byte is needed."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit PCM file as written here")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def cut_points(media: bytes, least: int = LEAST, bits: int = MASK_BITS, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks. The gear hash at a byte is the sum of the last 32 gear words, each shifted by its age."""
    n = len(media)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(media, dtype=np.uint8)]
    for span in (1, 2, 4, 8, 16):  # window sums by doubling
        shifted = h[:-span] << np.uint32(span) if span < n else h[:0]
        h = np.r_[h[:span], h[span:] + shifted]
    marks = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()
    ends, start, k = [], 0, 0
    while n - start > least:
        while k < len(marks) and marks[k] < start + least:
            k += 1
        end = min(marks[k] if k < len(marks) else n, start + greatest, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def feature_of(samples: bytes) -> str:
    """Exact integers of the samples: count, sum, sum of squares about 128, crossings of 128, commonest value."""
    a = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    centred = a - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return f"n={len(a)};sum={int(a.sum())};energy={int((centred * centred).sum())};crossings={crossings};mode={int(np.bincount(a, minlength=256).argmax())}"


LIST = "id {kind}, n_bytes bigint, media binary, whole binary, names array<binary>"
CHUNK = "name binary, size int, data binary"


def pieces_of(text: bytes) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The media file of a text, and its chunks in order: (name, bytes)."""
    file = wav(payload_of(text))
    ends = cut_points(file)
    return file, [(hashlib.sha256(file[a:b]).digest(), file[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def listed(batches):
    """(id, text) to the row's media name, file digest and ordered chunk names."""
    for batch in batches:
        for part in slices(batch, most=8 << 20):
            sizes, media_name, whole, names = [], [], [], []
            for text in texts_of(part):
                file, pieces = pieces_of(text)
                own = [name for name, _ in pieces]
                sizes.append(len(text))
                media_name.append(hashlib.sha256(b"".join(own)).digest())
                whole.append(hashlib.sha256(file).digest())
                names.append(own)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(media_name, pa.binary()), pa.array(whole, pa.binary()), pa.array(names, pa.list_(pa.binary()))], ["id", "n_bytes", "media", "whole", "names"])


def chunked(batches):
    """(text) to its chunks, compressed, but for those that this task has sent already."""
    sent: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=9).compress
    for batch in batches:
        for part in slices(batch, most=8 << 20):
            out = []
            for text in texts_of(part):
                for name, piece in pieces_of(text)[1]:
                    if name not in sent:
                        sent.add(name)
                        out.append((name, len(piece), pack(piece)))
            if len(sent) > 500_000:  # 32 bytes each; a name sent again is dropped in the shuffle
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.binary()))], ["name", "size", "data"])


READ = "media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, file binary"


def read_back(keep_file: bool):
    """Rows (media, whole, n, at, name, data), those of a media consecutive and in order, to one row per media."""

    def finish(media: bytes, whole: bytes, pieces: list[bytes]) -> dict:
        file = b"".join(pieces)
        if hashlib.sha256(file).digest() != whole:
            raise ValueError(f"media {media.hex()} does not match its digest")
        samples = samples_of(file)
        return {"media": media, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(file), "media_sha256": whole.hex(), "feature": feature_of(samples), "file": file if keep_file else None}

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        pieces: list[bytes] = []
        fields = [("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("file", pa.binary())]
        for batch in batches:
            done = []
            for media, whole, n, name, data in zip(*(batch.column(c).to_pylist() for c in ("media", "whole", "n", "name", "data")), strict=True):
                piece = unpack(data)
                if hashlib.sha256(piece).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not match its name")
                pieces.append(piece)
                if len(pieces) == n:
                    done.append(finish(media, whole, pieces))
                    pieces = []
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(fields))
        if pieces:
            raise ValueError("a media lacks chunks")

    return run


def store_chunks(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk once, in a table bucketed by name in the shared folder."""
    spark = chunks.sparkSession
    n = partitions(spark)
    once = chunks.groupBy("name").agg(F.first("size").alias("size"), F.first("data").alias("data"))
    name = f"credenza_chunks_{uuid.uuid4().hex}"
    once.write.bucketBy(n, "name").sortBy("name").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_file: bool = False) -> DataFrame:
    """Per row: id, n_bytes, and what is read back from the store: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and, if asked for, the file itself."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    # The two tables of the medium. Texts are cut once for each, which costs less than keeping all bytes twice.
    lists = save(narrow.mapInArrow(listed, LIST.format(kind=kind)), "media")
    store = store_chunks(narrow.select("text").mapInArrow(chunked, CHUNK))
    release(spark)
    media = lists.groupBy("media").agg(F.first("whole").alias("whole"), F.first("names").alias("names"))
    wanted = media.select("media", "whole", F.size("names").alias("n"), F.posexplode("names").alias("at", "name"))
    found = wanted.join(store.select("name", "data"), "name")
    single = found.filter("n = 1").mapInArrow(read_back(keep_file), READ)
    several = found.filter("n > 1").repartition(partitions(spark), "media").sortWithinPartitions("media", "at").mapInArrow(read_back(keep_file), READ)
    read = single.unionByName(several)
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["file"] if keep_file else [])]
    return lists.select("id", "n_bytes", "media").join(read, "media").select(F.col("id").alias(id_col), "n_bytes", *columns)

