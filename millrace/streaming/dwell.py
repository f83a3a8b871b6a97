"""Dwell as a stateful stream: late, repeated and unordered events, timers and expiry.

A user's events wait in state until the watermark has passed them: then no
earlier one can come, and the time until the next event is final. What is kept
of a user is the events still waiting and the last one that was settled; both
go when the user has been idle for long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session_id bigint, listing_id bigint, ts bigint, dwell_ms bigint"


class Dwell(StatefulProcessor):
    def __init__(self, least_ms: int, idle_ms: int):
        self.least_ms, self.idle_ms = least_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # By time and id, so an event that comes again is the same entry.
        self.waiting = handle.getMapState("waiting", "ts bigint, id bigint", "listing_id bigint")
        self.last = handle.getValueState("last", "ts bigint, id bigint, listing_id bigint")

    def _wake(self, at: int | None) -> None:
        """One timer a user: when the next waiting event is settled, or when the user counts as gone."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _next(self) -> int | None:
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            return first
        return self.last.get()[0] + self.idle_ms if self.last.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        settled = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for ts, id, listing in zip(frame.ms, frame.id, frame.listing_id, strict=True):
                if ts > settled:  # what comes later than the watermark allows is left out
                    self.waiting.updateValue((int(ts), int(id)), (None if pd.isna(listing) else int(listing),))
        self._wake(self._next())
        yield pd.DataFrame({"session_id": [], "listing_id": [], "ts": [], "dwell_ms": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        settled = timerValues.getCurrentWatermarkInMs()
        before = self.last.get() if self.last.exists() else None
        out = []
        for ts, id in sorted((k[0], k[1]) for k in self.waiting.keys()):
            if ts > settled:
                break
            if before is not None and ts - before[0] >= self.least_ms:
                out.append((key[0], before[2], before[0], ts - before[0]))
            before = (ts, id, self.waiting.getValue((ts, id))[0])
            self.waiting.removeKey((ts, id))
        if before is not None and before[0] + self.idle_ms <= settled and not any(True for _ in self.waiting.keys()):
            self.last.clear()
        elif before is not None:
            self.last.update(tuple(before))
        self._wake(self._next())
        yield pd.DataFrame(out, columns=["session_id", "listing_id", "ts", "dwell_ms"]).astype({"session_id": "int64", "listing_id": "Int64", "ts": "int64", "dwell_ms": "int64"})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB state store; the setting is the session's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def dwell_stream(events: DataFrame, *, least_ms: int = 3000, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """A stream (session_id, listing_id, ts, dwell_ms) of what events.dwell says of the same events at rest.

    events: a stream of event_id, ts, user_id and, if given, listing_id. Events count once by time and id, in the order of those,
    whatever order they come in; such as come later than `late` are left out. A result comes once the watermark has passed
    the later of its two events. After idle_ms without an event a user is forgotten, and the next event begins anew.
    """
    listing = F.col("listing_id").cast("bigint") if "listing_id" in events.columns else F.lit(None).cast("bigint")
    timed = events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("bigint").alias("id"), "user_id", listing.alias("listing_id"))
    own = timed.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return own.groupBy("user_id").transformWithStateInPandas(Dwell(least_ms, idle_ms), OUT, "append", "EventTime")
