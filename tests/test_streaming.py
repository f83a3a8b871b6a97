"""Streams of events against the same events at rest."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import events as batch
from millrace.streaming import dwell, sessions

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, listing_id bigint"


def _events(spark, rows):
    return spark.createDataFrame([(i, ms, u, x) for i, ms, u, x in rows], "event_id bigint, ms bigint, user_id bigint, listing_id bigint").select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", "listing_id")


def _run(spark, folder, rows, stream, out):
    """Write a batch of events, then run the stream to the end of what is there, from its checkpoint on."""
    _events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()


def _at_rest(spark, rows, least=3000):
    own = spark.createDataFrame(sorted(set(rows)), "id bigint, ts bigint, session_id bigint, listing_id bigint")
    return {tuple(r) for r in batch.dwell(own, least).select("session_id", "listing_id", "ts", "dwell_ms").collect()}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    dwell.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_dwell_in_three_batches(spark, tmp_path, rocks):
    """Unordered and repeated events, a restart between batches: the results are those at rest."""
    rng = random.Random(4)
    rows = [(i, 1_000_000 + rng.randrange(3_000_000), rng.randrange(6), rng.choice([None, 1, 2, 3])) for i in range(150)]
    rows.sort(key=lambda r: r[1] + rng.randrange(-200_000, 200_000))  # out of order by minutes
    out = f"{tmp_path}/out"
    stream = lambda e: dwell.dwell_stream(e, late="20 minutes")
    for i in range(3):
        part = rows[i * 50 : (i + 1) * 50]
        _run(spark, tmp_path, part + part[:7], stream, out)
    _run(spark, tmp_path, [(10_000, 20_000_000, -1, None)], stream, out)  # moves the watermark past all
    _run(spark, tmp_path, [(10_001, 20_000_001, -1, None)], stream, out)
    got = spark.read.parquet(out).where("session_id >= 0").select("session_id", "listing_id", "ts", "dwell_ms").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _at_rest(spark, rows)


def test_late_events_and_idle_users(spark, tmp_path, rocks):
    """What comes too late is left out; a user who was idle for long is forgotten."""
    out = f"{tmp_path}/out"
    stream = lambda e: dwell.dwell_stream(e, late="1 minute", idle_ms=600_000)
    _run(spark, tmp_path, [(1, 100_000, 1, 7), (2, 110_000, 1, 8)], stream, out)
    _run(spark, tmp_path, [(3, 5_000_000, 2, 9)], stream, out)
    _run(spark, tmp_path, [(4, 105_000, 1, 5), (5, 5_010_000, 2, 9), (6, 5_020_000, 1, 6)], stream, out)  # 4 is too late, 1 was forgotten
    _run(spark, tmp_path, [(7, 9_000_000, 3, 1)], stream, out)
    _run(spark, tmp_path, [(8, 9_000_001, 3, 1)], stream, out)
    got = {tuple(r) for r in spark.read.parquet(out).select("session_id", "listing_id", "ts", "dwell_ms").collect()}
    assert got == {(1, 7, 100_000, 10_000), (2, 9, 5_000_000, 10_000)}


def test_dwell_of_sessions(spark, tmp_path):
    """The plain stateful stream, batch by batch in order."""
    rows = [(i, 1000 * i * (1 + i % 3), i % 2, None) for i in range(40)]
    rows.sort(key=lambda r: r[1])
    out = f"{tmp_path}/out"
    for i in range(2):
        _run(spark, tmp_path, rows[i * 20 : (i + 1) * 20], sessions.dwell_stream, out)
    got = {tuple(r) for r in spark.read.parquet(out).select("user_id", "event_id", "dwell_ms").collect()}
    ids = {(r[2], r[1]): r[0] for r in rows}
    assert got == {(u, ids[u, ts], d) for u, _, ts, d in _at_rest(spark, rows)}
