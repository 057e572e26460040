"""Order-dependent operators that no built-in expresses: one group (a document) after the other, Arrow-batched.

Rows are dealt by group and sorted by Spark, so that a task reads its groups one behind the other and hands them on without
a call or a frame for each; it holds the rows of one group and of one batch. Groups are documents, whose lines and boxes
are bounded by one page; nothing here groups by account or corpus-wide keys.

Defined cases: rows that the order leaves open come in the order of their other columns; a null measure is like no other.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
NAN = float("nan")


def in_groups(rows: DataFrame, keys: list[str], order: list[Column], fn: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """rows: keys first. Each group's rows, as tuples in order, to rows of the schema."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = [part.split() for part in schema.split(", ")]
    target = pa.schema([(name, TYPES[kind]) for name, kind in fields])
    width = len(keys)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches):
        now, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != now:
                    if group:
                        out += fn(group)
                    now, group = row[:width], []
                group.append(row)
            yield batch_of(out)
        if group:
            yield batch_of(list(fn(group)))

    return ordered.mapInArrow(run, schema)


def measures(row: Iterable) -> list:
    return [NAN if v is None else v for v in row]


@lru_cache(maxsize=1 << 16)
def ratio(a: str | None, b: str | None) -> float:
    return 0.0 if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def leader_clusters(rows: DataFrame, least: float) -> DataFrame:
    """rows: doc_id, field, seq, value, conf. In order of seq, each value joins the first cluster whose leader is
    similar enough, else leads a new one. Returns doc_id, field, leader, size, best (of the highest confidence, first on ties), best_conf."""

    def cluster(group: list[tuple]) -> list[tuple]:
        clusters: list[list] = []  # leader, size, best, best_conf
        for *_, value, conf in group:
            for c in clusters:
                if c[0] == value or ratio(c[0], value) >= least:
                    c[1] += 1
                    if None not in (conf, c[3]) and conf > c[3]:
                        c[2:] = value, conf
                    break
            else:
                clusters.append([value, 1, value, conf])
        return [(*group[0][:2], *c) for c in clusters]

    order = [F.asc_nulls_last(c) for c in ("seq", "value", "conf")]
    return in_groups(rows.select("doc_id", "field", "seq", "value", F.col("conf").cast("double")), ["doc_id", "field"], order, cluster, "doc_id bigint, field string, leader string, size bigint, best string, best_conf double")


def line_groups(tokens: DataFrame, recent: int = 8) -> DataFrame:
    """tokens: doc_id, seq, yc, height. In order of seq, a token joins the most recent of the last lines whose mean
    centre is within max(12, 0.85 x its median height); else it starts a line. Adds line."""

    def group(page: list[tuple]) -> list[tuple]:
        lines: list[list] = []  # number of tokens, sum of centres, sorted heights
        out = []
        for doc, seq, *rest in page:
            yc, height = measures(rest)
            for k in range(len(lines) - 1, max(-1, len(lines) - 1 - recent), -1):
                n, centres, heights = lines[k]
                median = (heights[(n - 1) // 2] + heights[n // 2]) / 2
                if abs(yc - centres / n) <= max(12.0, 0.85 * median):
                    insort(heights, height)
                    lines[k] = [n + 1, centres + yc, heights]
                    break
            else:
                k = len(lines)
                lines.append([1, yc, [height]])
            out.append((doc, seq, k))
        return out

    return in_groups(tokens.select("doc_id", "seq", "yc", "height"), ["doc_id"], [F.asc_nulls_last(c) for c in ("seq", "yc", "height")], group, "doc_id bigint, seq bigint, line bigint")


def suppressed(boxes: DataFrame, most: float) -> DataFrame:
    """boxes: doc_id, box_id, x, y, w, h, conf. Greedy by confidence: drops boxes whose overlap with a kept one exceeds most."""

    def keep(page: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        out = []
        for doc, box, *rest in page:
            x, y, w, h = measures(rest[:4])
            right, low, area = x + w, y + h, w * h
            for kx, ky, kright, klow, karea in kept:
                inter = max(0, min(right, kright) - max(x, kx)) * max(0, min(low, klow) - max(y, ky))
                if inter / max(1, area + karea - inter) > most:
                    break
            else:
                kept.append((x, y, right, low, area))
                out.append((doc, box))
        return out

    order = [F.desc_nulls_last("conf"), *(F.asc_nulls_last(c) for c in ("box_id", "x", "y", "w", "h"))]
    return in_groups(boxes.select("doc_id", "box_id", "x", "y", "w", "h", "conf"), ["doc_id"], order, keep, "doc_id bigint, box_id bigint")


def label_matches(matches: DataFrame) -> DataFrame:
    """matches: doc_id, line, start, end, label_order. On each line, overlaps are resolved in order of (start, longest,
    label_order): a longer match takes the place of the shorter one that it meets, any other overlapping one is dropped."""

    def resolve(line: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []  # start, end, label_order
        open_: list[int] = []  # those that end behind the present start: later matches meet no others
        for *_, first, last, number in line:
            start, end = measures((first, last))
            open_ = [i for i in open_ if start < kept[i][1]]
            met = next((i for i in open_ if kept[i][0] < end), None)
            own = (start, end, number)
            if met is None:
                open_.append(len(kept))
                kept.append(own)
            elif (end - start, -number) > (kept[met][1] - kept[met][0], -kept[met][2]):
                kept[met] = own
        return [(*line[0][:2], *(None if v != v else v for v in m)) for m in kept]

    order = [F.asc_nulls_last("start"), (F.col("end") - F.col("start")).desc_nulls_last(), F.asc_nulls_last("label_order")]
    return in_groups(matches.select("doc_id", "line", "start", "end", "label_order"), ["doc_id", "line"], order, resolve, "doc_id bigint, line bigint, start bigint, end bigint, label_order bigint")
