"""Provenance manifests from files: the box that JPEG and PNG files carry, its nested boxes and their CBOR.

A store holds manifests in order, the last of which is active; a manifest holds a claim (who made it) and assertions (what was
done, and what it was made from: ingredients, which name other manifests of the store). Signatures are noted, not verified.

Defined cases: null files, files without a store and broken boxes have no rows; what a broken part leaves readable is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credenza.sources import rasters

SCHEMA = "manifest string, position int, active boolean, generator string, signed boolean, source_type string, actions array<string>, ingredients array<string>"
FIELDS = [("manifest", pa.string()), ("position", pa.int32()), ("active", pa.bool_()), ("generator", pa.string()), ("signed", pa.bool_()), ("source_type", pa.string()), ("actions", pa.list_(pa.string())), ("ingredients", pa.list_(pa.string()))]
#: Deepest nesting of boxes and of CBOR values that is read.
DEEPEST = 32


def cbor(data: bytes, at: int = 0, depth: int = 0):
    """The value that begins at a place, and the place after it."""
    if depth > DEEPEST:
        raise ValueError("nested too deep")
    kind, low = data[at] >> 5, data[at] & 31
    at += 1
    if kind == 7 and low in (25, 26, 27):
        size = 1 << (low - 24)
        return struct.unpack_from({2: ">e", 4: ">f", 8: ">d"}[size], data, at)[0], at + size
    if low < 24:
        n = low
    elif low < 28:
        size = 1 << (low - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    elif low == 31:
        n = None
    else:
        raise ValueError("reserved length")
    if kind in (0, 1):
        return (n if kind == 0 else -1 - n), at
    if kind in (2, 3):
        if n is None:  # pieces up to a break
            parts = []
            while data[at] != 0xFF:
                part, at = cbor(data, at, depth + 1)
                parts.append(part)
            return (b"" if kind == 2 else "").join(parts), at + 1
        if at + n > len(data):
            raise ValueError("cut off")
        return (data[at : at + n] if kind == 2 else data[at : at + n].decode("utf-8", "replace")), at + n
    if kind in (4, 5):
        values = []
        while (data[at] != 0xFF) if n is None else len(values) < n * (kind - 3):
            value, at = cbor(data, at, depth + 1)
            values.append(value)
        at += n is None
        return (values if kind == 4 else {k if isinstance(k, (str, int, bytes)) else str(k): v for k, v in zip(values[::2], values[1::2], strict=True)}), at
    if kind == 6:
        return cbor(data, at, depth + 1)
    return {20: False, 21: True}.get(n), at


def to_cbor(value) -> bytes:
    """A value (None, bool, int, text, bytes, list, dict with text keys) as CBOR."""

    def head(kind: int, n: int) -> bytes:
        if n < 24:
            return bytes([kind << 5 | n])
        low = 24 if n < 1 << 8 else 25 if n < 1 << 16 else 26 if n < 1 << 32 else 27
        return bytes([kind << 5 | low]) + n.to_bytes(1 << (low - 24), "big")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, (str, bytes)):
        raw = value.encode() if isinstance(value, str) else value
        return head(3 if isinstance(value, str) else 2, len(raw)) + raw
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(to_cbor, value))
    return head(5, len(value)) + b"".join(to_cbor(k) + to_cbor(v) for k, v in value.items())


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def superbox(label: str, *children: bytes) -> bytes:
    return box(b"jumb", box(b"jumd", bytes(16) + b"\x03" + label.encode() + b"\0") + b"".join(children))


def write_store(manifests: list[dict]) -> bytes:
    """A store of manifests (manifest, generator, signed, source_type, actions, ingredients), unsigned in truth."""
    inner = []
    for m in manifests:
        said = [{"action": a} | ({"digitalSourceType": m["source_type"]} if m["source_type"] else {}) for a in m["actions"]]
        own = [superbox("c2pa.actions", box(b"cbor", to_cbor({"actions": said})))]
        own += [superbox(f"c2pa.ingredient__{i}", box(b"cbor", to_cbor({"c2pa_manifest": {"url": f"self#jumbf=/c2pa/{name}"}}))) for i, name in enumerate(m["ingredients"])]
        parts = [superbox("c2pa.assertions", *own), superbox("c2pa.claim", box(b"cbor", to_cbor({"claim_generator": m["generator"]})))]
        inner.append(superbox(m["manifest"], *parts, *([superbox("c2pa.signature", box(b"cbor", b"\x40"))] if m["signed"] else [])))
    return superbox("c2pa", *inner)


def in_png(content: bytes, store: bytes) -> bytes:
    """The PNG file with the store in a chunk after its header."""
    import zlib

    return content[:33] + struct.pack(">I", len(store)) + b"caBX" + store + struct.pack(">I", zlib.crc32(b"caBX" + store)) + content[33:]


def in_jpeg(content: bytes, store: bytes, most: int = 65_000) -> bytes:
    """The JPEG file with the store in segments after its start, each with the head of the store's box."""
    pieces = [store[i : i + most] for i in range(0, len(store), most)]
    bodies = [b"JP" + struct.pack(">HI", 1, k) + (p if k == 1 else store[:8] + p) for k, p in enumerate(pieces, 1)]
    return content[:2] + b"".join(b"\xff\xeb" + struct.pack(">H", len(b) + 2) + b for b in bodies) + content[2:]


def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Type and body of the boxes one after the other; a box that runs over the end stops them."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            return
        yield kind, data[at + head : at + size]
        at += size


def labelled(data: bytes) -> tuple[str, list[tuple[bytes, bytes]]]:
    """The label of a superbox and the boxes after its description."""
    own = list(boxes(data))
    if not own or own[0][0] != b"jumd" or len(own[0][1]) < 17:
        return "", []
    return own[0][1][17:].split(b"\0")[0].decode("utf-8", "replace") if own[0][1][16] & 2 else "", own[1:]


def store_of(content: bytes) -> bytes | None:
    """The store's box in a PNG file, or put together from the segments of a JPEG file."""
    if content[:8] == rasters.PNG:
        at = 8
        while at + 12 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"caBX":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    parts, at = {}, 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xEB and body[:2] == b"JP" and len(body) >= 16:
            number, packet = struct.unpack_from(">HI", body, 2)
            parts.setdefault(number, {})[packet] = body[8:]
        at += 2 + size
    for _, own in sorted(parts.items()):
        first, *rest = (own[k] for k in sorted(own))
        return first + b"".join(p[8:] for p in rest)  # later segments repeat the head of the box
    return None


def manifests_of(content: bytes | None) -> list[tuple]:
    """The columns of SCHEMA of each manifest."""
    out = []
    for kind, body in boxes(store_of(content or b"") or b""):
        label, children = labelled(body) if kind == b"jumb" else ("", [])
        if label != "c2pa":
            continue
        found = [labelled(b) for k, b in children if k == b"jumb"]
        out += [(name, i, i == len(found) - 1, *_parts(inner)) for i, (name, inner) in enumerate(found)]
    return out


def _parts(children: list[tuple[bytes, bytes]]) -> tuple:
    generator, signed, source, actions, ingredients = None, False, None, [], []

    def value(inner: list[tuple[bytes, bytes]]):
        for kind, body in inner:
            if kind == b"cbor":
                try:
                    return cbor(body)[0]
                except (ValueError, IndexError, struct.error):
                    return None
        return None

    for kind, body in children:
        label, inner = labelled(body) if kind == b"jumb" else ("", [])
        if label.startswith("c2pa.claim"):
            claim = value(inner)
            generator = claim.get("claim_generator") if isinstance(claim, dict) else None
        elif label == "c2pa.signature":
            signed = bool(inner)
        elif label == "c2pa.assertions":
            for name, own in (labelled(b) for k, b in inner if k == b"jumb"):
                said = value(own)
                if not isinstance(said, dict):
                    continue
                if name.startswith("c2pa.actions"):
                    for action in said.get("actions") or []:
                        if isinstance(action, dict):
                            actions.append(str(action.get("action")))
                            source = source or action.get("digitalSourceType")
                elif name.startswith("c2pa.ingredient"):
                    place = said.get("c2pa_manifest") or said.get("activeManifest")
                    url = place.get("url") if isinstance(place, dict) else place
                    if isinstance(url, str):
                        ingredients.append(url.rstrip("/").rsplit("/", 1)[-1])
    return generator, signed, source, actions, ingredients


def read_manifests(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A row per manifest of each file: key and the columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column("key")[k].as_py(), *row) for k in range(batch.num_rows) for row in manifests_of(batch.column("content")[k].as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field("key").type, *(t for _, t in FIELDS)], strict=True)], ["key", *(n for n, _ in FIELDS)])

    named = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)


def _walked(manifests: DataFrame, key: str, deepest: int) -> DataFrame:
    """A row per key: its manifests, and `depths`, by name how far the active one is from each that it comes from. A file's
    manifests are all in its own bytes, so that its walk is one over an array of one row: level by level, each name once."""
    held = [F.col(c) for c in manifests.columns if c != key]
    files = manifests.groupBy(key).agg(F.collect_list(F.struct(*held)).alias("own"))
    own = F.col("own")
    names = F.array_compact(F.transform(own, lambda m: m["manifest"]))
    first = F.array_distinct(F.transform(F.filter(own, lambda m: m["active"]), lambda m: m["manifest"]))
    at = lambda level, depth: F.transform(level, lambda name: F.struct(name.alias("manifest"), depth.alias("depth")))

    def further(state: Column, depth: Column) -> Column:
        from_here = F.flatten(F.transform(F.filter(own, lambda m: F.array_contains(state["level"], m["manifest"])), lambda m: F.coalesce(m["ingredients"], F.array().cast("array<string>"))))
        level = F.array_except(F.array_intersect(from_here, names), F.transform(state["seen"], lambda s: s["manifest"]))
        return F.struct(level.alias("level"), F.concat(state["seen"], at(level, depth)).alias("seen"))

    # A way without repetitions has no more steps than there are manifests.
    steps = F.sequence(F.lit(1), F.least(F.size(own), F.lit(deepest)))
    walk = F.aggregate(steps, F.struct(first.alias("level"), at(first, F.lit(0)).alias("seen")), further, lambda state: state["seen"])
    return files.withColumn("depths", walk)


def histories(manifests: DataFrame, path: str, key: str = "doc_id", deepest: int = DEEPEST) -> DataFrame:
    """The manifests that the active one of each file comes from, by ingredients of ingredients: key, manifest, depth (0: the active
    one; the least, where there are several ways). A way that comes back to a manifest ends there. Written under `path`."""
    found = _walked(manifests.select(key, "manifest", "active", "ingredients"), key, deepest).select(key, F.explode("depths").alias("__d")).select(key, "__d.manifest", "__d.depth")
    found.write.mode("overwrite").parquet(path)
    return manifests.sparkSession.read.schema(found.schema).parquet(path)


def rolled_up(manifests: DataFrame, key: str = "doc_id", deepest: int = DEEPEST) -> DataFrame:
    """Per file: manifests, signed ones, the active generator, its source type, actions of its history (from the oldest), depth."""
    own = F.col("own")
    # Manifests without a name, or of no file, are in no history.
    depth_of = F.map_from_entries(F.filter("depths", lambda d: d["manifest"].isNotNull() & F.col(key).isNotNull()))
    placed = F.transform(own, lambda m: F.struct(F.try_element_at(F.col("depth_of"), m["manifest"]).alias("depth"), m["position"].alias("position"), m["actions"].alias("actions")))
    told = F.array_sort(F.transform(F.filter("placed", lambda m: m["depth"].isNotNull()), lambda m: F.struct(-m["depth"], m["position"], m["actions"].alias("actions"))))
    of_active = lambda c: F.array_max(F.transform(F.filter(own, lambda m: m["active"]), lambda m: m[c]))
    return _walked(manifests, key, deepest).withColumn("depth_of", depth_of).withColumn("placed", placed).select(
        key, F.size(own).cast("bigint").alias("n_manifests"), F.size(F.filter(own, lambda m: m["signed"])).cast("bigint").alias("n_signed"), of_active("generator").alias("generator"), of_active("source_type").alias("source_type"),
        F.array_max(F.transform("placed", lambda m: m["depth"])).alias("depth"), F.array_join(F.flatten(F.transform(told, lambda t: t["actions"])), ">").alias("history"),
    )
