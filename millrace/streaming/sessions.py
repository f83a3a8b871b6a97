"""Streams of session events. Windows, watermarks and stateful dwell are extras beyond the reference's own behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*events*").parquet(folder)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """An append-only copy of the stream, exactly once by the checkpoint."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by kind and tumbling window; what comes later than late is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's sessions: events with less than gap between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dwell_stream(events: DataFrame, least_ms: int = 3000) -> DataFrame:
    """(user_id, event_id, dwell_ms) as a stream: the time until a user's next event, from least_ms up; the last event's place is kept as state, a pair a user."""
    import pandas as pd

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        before = state.get if state.exists else None
        out = []
        for event_id, ms in zip(rows.event_id, rows.ms, strict=True):
            if before is not None and ms - before[1] >= least_ms:
                out.append((key[0], before[0], int(ms - before[1])))
            before = (int(event_id), int(ms))
        state.update(before)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "dwell_ms"])

    own = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, dwell_ms bigint", "event_id bigint, ms bigint", "append", "NoTimeout")
