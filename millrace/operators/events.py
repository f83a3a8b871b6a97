"""Session events: append, recent clicks, recent events, dwell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("click", "dwell", "save")


def append(events: DataFrame, path: str) -> None:
    """Rows (session_id, event_type, listing_id, dwell_ms) with the time of arrival; other kinds are refused."""
    if events.where(~F.col("event_type").isin(*KINDS) | F.col("event_type").isNull()).take(1):
        raise ValueError(f"event_type is one of {KINDS}")
    stamped = events.withColumns({"id": F.expr("uuid()"), "ts": F.unix_millis(F.current_timestamp())})
    stamped.select("id", "session_id", "event_type", "listing_id", "ts", "dwell_ms").write.mode("append").parquet(path)


def recent_clicks(events: DataFrame, n: int) -> DataFrame:
    """(session_id, listing_id, ts, rank): the last n listings clicked or saved, each at its latest time."""
    latest = events.where(F.col("event_type").isin("click", "save") & F.col("listing_id").isNotNull()).groupBy("session_id", "listing_id").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "listing_id")
    return latest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each session, newest first."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dwell(selections: DataFrame, least_ms: int = 3000) -> DataFrame:
    """(session_id, listing_id, ts, dwell_ms): how long a listing stayed selected until the next, from least_ms up."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    return selections.withColumn("dwell_ms", F.lead("ts").over(w) - F.col("ts")).where(F.col("dwell_ms") >= least_ms).select("session_id", "listing_id", "ts", "dwell_ms")
