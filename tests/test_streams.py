"""Keyed state against batch results: frames that come late, lockouts that extend themselves."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from credenza.operators import history
from credenza.streaming import auth, frames

START = dt.datetime(2026, 3, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_late_frames_take_their_place(spark, tmp_path):
    """Frames in five files, many of them late: after each batch a user's result is that of all its frames so far."""
    rng = random.Random(1)
    rows = [(u, at(rng.randrange(500)), 100 * u + i, [rng.random() * 100 for _ in range(4)]) for u in (1, 2, 3) for i in range(rng.choice((1, 2, 14, 25)) if u > 1 else 30)]
    rng.shuffle(rows)
    schema = "user_id bigint, at timestamp, id bigint, pixels array<double>"
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = auth.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    got = frames.run_updates(frames.last_frames(stream, threshold=30.0), f"{tmp_path}/out", "user_id")
    want = frames.motion_of(spark.createDataFrame(rows, schema), threshold=30.0)
    key = lambda r: (r.user_id, r.samples, round(r.motion, 9), round(r.peak, 9), r.active, r.passed)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert spark.read.parquet(f"{tmp_path}/out/rows").select("batch").distinct().count() == 5
    user = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], r[2]))[-10:]
    changes = [sum(abs(x - y) for x, y in zip(a[3], b[3], strict=True)) / 4 for a, b in zip(user, user[1:], strict=False)]
    row = next(r for r in want.collect() if r.user_id == 1)
    assert abs(row.motion - sum(changes) / 9) < 1e-9 and row.samples == 9 and row.active == sum(c > 30 for c in changes)


def plain_lockouts(rows, most, minutes):
    """rows: (user, at, id, success) to ids of throttled attempts."""
    out, failures = set(), {}
    for user, when, number, ok in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        own = failures.setdefault(user, [])
        throttled = sum(f >= when - dt.timedelta(minutes=minutes) for f in own) >= most
        if throttled:
            out.add(number)
        if throttled or not ok:
            own.append(when)
    return out


def test_lockouts_extend_themselves(spark):
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 2, 3, None)), at(rng.randrange(2000)), i, rng.random() < 0.5) for i in range(1500)]
    rows += [(9, at(k), 5000 + k, k > 4) for k in range(0, 60)]  # five failures, then a try a minute: all throttled
    df = spark.createDataFrame(rows, "u bigint, at timestamp, id bigint, ok boolean").withColumns({"user": F.lit("x"), "row": F.lit(1)})
    for most, minutes in ((5, 15), (1, 3), (3, 60)):
        got = {r.id for r in history.lockouts(df, "u", "at", "id", "ok", most, minutes).filter("throttled").collect()}
        assert got == plain_lockouts(rows, most, minutes)
    assert {5000 + k for k in range(5, 60)} <= {r.id for r in history.lockouts(df, "u", "at", "id", "ok").filter("throttled").collect()}
    assert history.lockouts(df.limit(0), "u", "at", "id", "ok").collect() == []
