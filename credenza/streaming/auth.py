"""Structured Streaming over login and document events: throttle, duplicates, sessions, one-time codes.

All take a streaming (or batch) DataFrame with event time `at` (TIMESTAMP). State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def failures_by_window(events: DataFrame, span: str = "15 minutes", slide: str | None = None, late: str = "15 minutes") -> DataFrame:
    """Failed logins per user and window."""
    window = F.window("at", span, slide) if slide else F.window("at", span)
    return events.filter("NOT success").withWatermark("at", late).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("failures")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "failures")


def first_uses(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event per key within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "7 days", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def used_codes(issued: DataFrame, used: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Codes used within their lifetime: an interval join of two streams on the key."""
    a = issued.withWatermark("issued_at", within)
    b = used.withWatermark("used_at", within)
    return a.join(b, F.expr(f"issued_key = used_key AND used_at >= issued_at AND used_at <= issued_at + INTERVAL {within}"))


def throttled_rows(attempts: list[tuple[int, bool]], failures: list[int], most: int, span: int) -> list[bool]:
    """Whether each attempt (time, success) of one user, in order, is throttled: the last `most` failures all lie within the
    span before it. A throttled attempt is a failure. failures: the times of the last `most`, before and after the call."""
    flags = []
    for at, success in attempts:
        throttled = len(failures) >= most and failures[-most] >= at - span
        flags.append(throttled)
        if throttled or not success:
            failures.append(at)
            del failures[:-most]
    return flags


def lockouts(events: DataFrame, most: int = 5, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Login attempts with whether each is throttled: at least `most` failures in the trailing window. A throttled
    attempt is itself a failure and extends the lockout. State: the times of a user's last `most` failures, dropped when
    the watermark has passed them by the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        attempts = [(int(at.timestamp() * 1_000_000), bool(ok)) for at, ok in zip(rows["at"], rows["success"], strict=True)]
        flags = throttled_rows(attempts, failures, most, minutes * 60_000_000)
        state.update((failures,))
        state.setTimeoutTimestamp(max(max(failures, default=0) // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "at": rows["at"], "throttled": flags})

    marked = events.withWatermark("at", late)
    return marked.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at timestamp, throttled boolean", "failures array<bigint>", "append", "EventTimeTimeout")


def run_available(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now into Parquet under `folder` and returns it. Appended rows go to a file
    sink; a complete result replaces the one of the batch before."""
    writer = df.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").outputMode(mode).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
