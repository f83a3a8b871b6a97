"""The versioned vector store against a dictionary."""

import random

import pytest

from millrace.operators import vector_store
from millrace.operators.vector_store import VectorStore
from millrace.sources.segments import SegmentLog

SCHEMA = "listing_id string, model_id string, vector array<float>"


def _rows(df):
    return {r.listing_id: (r.model_id, list(r.vector)) for r in df.collect()}


def test_versions(spark, tmp_path, monkeypatch):
    """Random upserts and deletions, each version read again at the end; compaction on the way."""
    monkeypatch.setattr(vector_store, "MOST_SEGMENTS", 3)
    rng = random.Random(3)
    store, now, states = VectorStore(spark, str(tmp_path), buckets=3), {}, {0: {}}
    for step in range(8):
        if step % 3 == 2:
            ids = rng.sample(range(30), 8)
            version = store.delete(spark.createDataFrame([(str(i),) for i in ids] + [(None,), ("unknown",)], "listing_id string"))
            now = {k: v for k, v in now.items() if int(k) not in ids}
        else:
            new = {str(i): (f"m{step % 2}", [float(step), float(i)]) for i in rng.sample(range(30), 12)}
            again = [(k, "a", [9.0, 9.0]) for k in list(new)[:3]] + [(None, "m9", [1.0, 1.0])]
            version = store.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()] + again, SCHEMA))
            now = now | new
        states[version] = dict(now)
    assert sorted(states) == list(range(9))
    assert _rows(store.read()) == now
    for version, state in states.items():
        assert _rows(VectorStore(spark, str(tmp_path)).read(version)) == state
    assert store.count("m1").first().n == sum(m == "m1" for m, _ in now.values())
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "listing_id string")
    assert _rows(store.fetch(asked)) == {k: v for k, v in now.items() if k in set("123")}
    assert {r.listing_id for r in store.backlog(asked, "m0").distinct().collect()} == {k for k in ("1", "2", "3") if now.get(k, ("",))[0] != "m0"}
    assert store.compact() == 9 and _rows(store.read()) == now and store.compact() == 9
    store.vacuum()
    assert store.log.versions() == [9] and _rows(store.read()) == now
    with pytest.raises(ValueError):
        store.read(3)


def test_writers_do_not_overwrite(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path))
    assert log.commit(0, ["a"]) == 1
    with pytest.raises(RuntimeError):
        log.commit(0, ["b"])
    assert log.read()[:2] == (1, ["a"])


def test_vectors_are_not_shuffled(spark, tmp_path):
    """Merging on read exchanges no vectors: segments meet by their buckets."""
    store = VectorStore(spark, str(tmp_path), buckets=4)
    store.upsert(spark.createDataFrame([(str(i), "m", [float(i)]) for i in range(50)], SCHEMA))
    store.upsert(spark.createDataFrame([(str(i), "n", [float(-i)]) for i in range(20)], SCHEMA))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
