"""Pages of PDF files: their order by the page tree, and the largest embedded image of each.

Read are indirect objects in plain form and in object streams, pages through the tree of the catalogue, resources that pages inherit,
and images that are JPEG files or deflated 8-bit grey or RGB samples (with or without PNG row filters), which become PNG
files. There is no renderer: a page without such an image has a row of nulls.

Defined cases: files without a catalogue, null and broken files have no pages; a tree with cycles is walked once per object.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

from credenza.sources import rasters

#: Pages of a file that are read, least shorter side of an image, least longer side where more detail is asked for.
MOST_PAGES, LEAST_SIDE, LEAST_DETAIL = 3, 500, 1400

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
TOKEN = re.compile(rb"<<|>>|\[|\]|\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]*|(\d+)\s+\d+\s+R\b|[^\s/<>\[\]()%]+|%[^\r\n]*")


class Ref(int):
    """The number of an indirect object."""


def value_of(body: bytes):
    """The first value in the body: a dict, list, Ref, number, or bytes (names with their slash)."""
    stack: list[list] = [[]]
    for token in TOKEN.finditer(body):
        text = token[0]
        if text.startswith(b"%"):
            continue
        if text in (b"<<", b"["):
            stack.append([])
            continue
        if text in (b">>", b"]"):
            if len(stack) < 2:
                break
            done = stack.pop()
            value = dict(zip(done[::2], done[1::2], strict=False)) if text == b">>" else done
        elif token[1] is not None:
            value = Ref(token[1])
        else:
            value = int(text) if re.fullmatch(rb"[+-]?\d+", text) else text
        stack[-1].append(value)
        if len(stack) == 1:
            return value
    return None


class File:
    """The objects of a file by number: their values, and the bytes of streams."""

    def __init__(self, content: bytes):
        self.values: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        places = list(OBJECT.finditer(content))
        for found, after in zip(places, [*places[1:], None], strict=False):
            body = content[found.end() : after.start() if after else len(content)]
            number = int(found[1])
            self.values[number] = value_of(body)
            start = re.search(rb">>\s*stream\r?\n", body)
            if start and isinstance(self.values[number], dict):
                self.streams[number] = content[found.end() + start.end() :]
        for number in list(self.streams):
            self.streams[number] = self.cut(number)
        for number in [n for n in self.streams if self.values[n].get(b"/Type") == b"/ObjStm"]:
            self.unpack(number)

    def cut(self, number: int) -> bytes:
        raw, size = self.streams[number], self.get(self.values[number].get(b"/Length"))
        if isinstance(size, int) and re.match(rb"\s*endstream", raw[size : size + 12]):
            return raw[:size]
        return raw[: max(0, raw.find(b"endstream"))].rstrip(b"\r\n")

    def get(self, value):
        return self.values.get(int(value)) if isinstance(value, Ref) else value

    def filters(self, number: int) -> list:
        found = self.get(self.values[number].get(b"/Filter"))
        return found if isinstance(found, list) else [found] if found else []

    def unpack(self, number: int) -> None:
        own = self.values[number]
        try:
            data = zlib.decompress(self.streams[number]) if self.filters(number) == [b"/FlateDecode"] else self.streams[number]
            first = self.get(own[b"/First"])
            head = list(map(int, data[:first].split()))
        except (zlib.error, KeyError, ValueError, TypeError):
            return
        for inner, place in zip(head[::2], head[1::2], strict=False):
            self.values.setdefault(inner, value_of(data[first + place :]))

    def pages(self) -> Iterator[dict]:
        """Pages in order, each with the resources that it has or inherits."""
        roots = [v for v in self.values.values() if isinstance(v, dict) and v.get(b"/Type") == b"/Catalog"]
        waiting, seen = [(roots[-1].get(b"/Pages"), None)] if roots else [], set()
        while waiting:
            place, resources = waiting.pop()
            node = self.get(place)
            if not isinstance(node, dict) or (isinstance(place, Ref) and place in seen):
                continue
            seen.add(place if isinstance(place, Ref) else None)
            resources = self.get(node.get(b"/Resources")) or resources
            kids = self.get(node.get(b"/Kids"))
            if isinstance(kids, list):
                waiting += [(kid, resources) for kid in reversed(kids)]
            else:
                yield {"resources": resources or {}}

    def images(self, page: dict) -> list[tuple[int, int, int]]:
        """(width, height, object) of the page's images, the largest first, of equals the later object."""
        objects = self.get(page["resources"].get(b"/XObject")) if isinstance(page["resources"], dict) else None
        out = []
        for place in (objects or {}).values() if isinstance(objects, dict) else ():
            own = self.get(place)
            if isinstance(place, Ref) and isinstance(own, dict) and own.get(b"/Subtype") == b"/Image" and place in self.streams:
                width, height = self.get(own.get(b"/Width")), self.get(own.get(b"/Height"))
                if isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0:
                    out.append((width, height, int(place)))
        return sorted(out, key=lambda x: (-x[0] * x[1], -x[2]))

    def image(self, number: int, width: int, height: int) -> bytes | None:
        """The image as a file, or None where its form isn't read here."""
        own, filters = self.values[number], self.filters(number)
        if filters == [b"/DCTDecode"]:
            return self.streams[number]
        channels = {b"/DeviceGray": 1, b"/DeviceRGB": 3}.get(self.get(own.get(b"/ColorSpace")))
        if filters not in ([], [b"/FlateDecode"]) or channels is None or self.get(own.get(b"/BitsPerComponent")) != 8:
            return None
        try:
            data = zlib.decompress(self.streams[number]) if filters else self.streams[number]
            said = self.get(own.get(b"/DecodeParms")) or {}
            if isinstance(said, dict) and self.get(said.get(b"/Predictor", 1)) >= 10:
                data = rasters.unfiltered(np.frombuffer(data, dtype=np.uint8).reshape(height, width * channels + 1), channels).tobytes()
            return rasters.write_png(width, height, channels, data[: width * height * channels], (0,))
        except (zlib.error, ValueError, TypeError):
            return None


def pages_of(content: bytes | None, most: int = MOST_PAGES, least_side: int = LEAST_SIDE, least_detail: int = 0) -> Iterator[tuple[int, int | None, int | None, bytes | None]]:
    """Page number from 1, width, height and file of each of the first `most` pages' largest image whose shorter side is at least
    least_side and whose longer is at least least_detail."""
    file = File(content or b"")
    for number, page in zip(range(1, most + 1), file.pages(), strict=False):
        for width, height, place in file.images(page):
            found = file.image(place, width, height) if min(width, height) >= least_side and max(width, height) >= least_detail else None
            if found is not None:
                yield number, width, height, found
                break
        else:
            yield number, None, None, None
