"""Raster images from file bytes: PNG and BMP, read and written losslessly in Arrow batches.

A raster is a row of width, height, channels (1 grey, 2 grey and alpha, 3 RGB, 4 RGBA) and samples (8 bits each, rows from the top,
pixels from the left, channels within a pixel). Palettes are resolved and 16-bit samples keep their high byte.

Defined cases: null, empty, cut off or otherwise broken files, other formats, interlaced PNG files and images of more than `most`
pixels give a raster of nulls; nothing is dropped. Bytes after the image are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signature, and samples per pixel by colour type (3: palette).
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of the largest image that is read, and bytes of samples in an output batch.
MOST, BATCH = 1 << 26, 16 << 20


def unfiltered(raw: np.ndarray, pixel: int) -> np.ndarray:
    """Rows of (filter type, filtered bytes) to bytes; pixel: bytes of a whole pixel, at least 1."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    out = np.zeros((len(rows) + 1, rows.shape[1] + pixel), dtype=np.uint8)  # one row above and one pixel to the left are zero
    for y, kind in enumerate(kinds.tolist()):
        row, above, now = rows[y], out[y], out[y + 1]
        if kind == 0:
            now[pixel:] = row
        elif kind == 1:  # sums along the row, byte of a pixel by byte of a pixel
            for c in range(pixel):
                now[pixel + c :: pixel] = np.cumsum(row[c::pixel], dtype=np.uint8)
        elif kind == 2:
            now[pixel:] = row + above[pixel:]
        elif kind in (3, 4):
            _sequential(kind, row.tolist(), above.tolist(), now, pixel)
        else:
            raise ValueError("unknown filter")
    return out[1:, pixel:]


def _sequential(kind: int, row: list[int], above: list[int], now: np.ndarray, pixel: int) -> None:
    """Average and Paeth: each byte depends on the one before it, of the same channel."""
    for channel in range(pixel):
        done, a, c = [], 0, 0
        values = zip(row[channel::pixel], above[pixel + channel :: pixel], strict=True)
        if kind == 3:
            for value, b in values:
                a = (value + ((a + b) >> 1)) & 255
                done.append(a)
        else:
            for value, b in values:
                # a, b, c: to the left, above, and above to the left; the nearest to a + b - c.
                x, y = b - c, a - c
                z = x + y
                if x < 0:
                    x = -x
                if y < 0:
                    y = -y
                if z < 0:
                    z = -z
                a = (value + (a if x <= y and x <= z else b if y <= z else c)) & 255
                done.append(a)
                c = b
        now[pixel + channel :: pixel] = done


def read_png(content: bytes, most: int) -> tuple[int, int, int, bytes]:
    at, header, data, palette = len(PNG), None, [], None
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", content, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    if interlaced or colour not in CHANNELS or not width or not height or width * height > most:
        raise ValueError("not supported")
    n = CHANNELS[colour]
    line = (width * n * depth + 7) // 8
    inflater = zlib.decompressobj()
    raw = inflater.decompress(b"".join(data), (line + 1) * height)
    rows = unfiltered(np.frombuffer(raw, dtype=np.uint8).reshape(height, line + 1), max(1, n * depth // 8))
    if depth == 16:
        samples = rows[:, ::2]
    elif depth == 8:
        samples = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * n]
        samples = (bits * (1 << np.arange(depth)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
        if colour == 0:
            samples = samples * np.uint8(255 // ((1 << depth) - 1))
    if colour == 3:
        if palette is None or int(samples.max()) >= len(palette):
            raise ValueError("no palette")
        samples, n = palette[samples], 3
    return width, height, n, np.ascontiguousarray(samples).tobytes()


def read_bmp(content: bytes, most: int) -> tuple[int, int, int, bytes]:
    start, size, width, height, _, depth, packing = struct.unpack_from("<10xIIiiHHI", content)
    down, height = height < 0, abs(height)
    if packing not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or not height or width * height > most:
        raise ValueError("not supported")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, dtype=np.uint8, count=line * height, offset=start).reshape(height, line)
    rows = rows[:, : width * depth // 8] if down else rows[::-1, : width * depth // 8]
    if depth == 8:
        colours = np.frombuffer(content, dtype=np.uint8, count=(struct.unpack_from("<I", content, 46)[0] or 256) * 4, offset=14 + size).reshape(-1, 4)
        pixels = colours[rows][:, :, 2::-1]
    else:
        pixels = rows.reshape(height, width, depth // 8)[:, :, 2::-1]  # blue, green, red (and a fourth byte without meaning)
    return width, height, 3, np.ascontiguousarray(pixels).tobytes()


def read(content: bytes | None, most: int = MOST) -> tuple[int, int, int, bytes] | None:
    """Width, height, channels and samples, or None if the file can't be read."""
    try:
        if content and content[:8] == PNG:
            return read_png(content, most)
        if content and content[:2] == b"BM":
            return read_bmp(content, most)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def write_png(width: int, height: int, channels: int, samples: bytes, filters: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """An 8-bit PNG file whose rows take the filters in turn."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(height, width * channels).astype(np.int16)
    padded = np.zeros((height + 1, (width + 1) * channels), dtype=np.int16)
    padded[1:, channels:] = rows
    a, b, c = padded[1:, :-channels], padded[:-1, channels:], padded[:-1, :-channels]
    near = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)])
    paeth = np.choose(near.argmin(axis=0), [a, b, c])
    guesses = np.stack([np.zeros_like(rows), a, b, (a + b) >> 1, paeth])
    kinds = np.resize(np.array(filters, dtype=np.uint8), height)
    body = (rows - guesses[kinds, np.arange(height)]).astype(np.uint8)
    raw = np.concatenate([kinds[:, None], body], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = {n: k for k, n in CHANNELS.items() if k != 3}[channels]
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def write_bmp(width: int, height: int, channels: int, samples: bytes) -> bytes:
    """A 24-bit BMP file, rows from the bottom; grey becomes three equal channels."""
    pixels = np.frombuffer(samples, dtype=np.uint8).reshape(height, width, channels)
    colours = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
    line = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, line), dtype=np.uint8)
    rows[:, : 3 * width] = colours[::-1, :, ::-1].reshape(height, 3 * width)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def read_rasters(files: DataFrame, key: str = "doc_id", content: str = "content", most: int = MOST) -> DataFrame:
    """Rows (key, content) to (key, width, height, channels, samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                found = read(batch.column("content")[k].as_py(), most)
                rows.append((batch.column("key")[k], *(found or (None,) * 4)))
                held += len(found[3]) if found else 0
                if held > BATCH:
                    yield _rasters(rows, batch.schema.field("key").type)
                    rows, held = [], 0
            if rows:
                yield _rasters(rows, batch.schema.field("key").type)

    named = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, width int, height int, channels int, samples binary").withColumnRenamed("key", key)


def _rasters(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in columns[0]], kind), *[pa.array(c, t) for c, t in zip(columns[1:], kinds[1:], strict=True)]], ["key", "width", "height", "channels", "samples"])
