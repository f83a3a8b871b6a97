"""Blocked retrieval against plain loops."""

import random

import numpy as np
import pytest

from millrace.operators import dense

NAN = float("nan")


def _data(seed, n=300, dim=6):
    rng = random.Random(seed)
    unit = lambda d: [x / 8 for x in rng.choices(range(-8, 9), k=d)]  # noqa: E731  coarse, so that many tie
    rows = [(f"v{i % 250}é" if i % 3 else f"v{i}", unit(dim), rng.choice("abc")) for i in range(n)]
    rows += [("none", None, "a"), ("empty", [], "a"), ("hole", [0.5] * (dim - 1) + [None], "a"), ("nan", [NAN] * dim, "a"), ("short", unit(3), "b"), ("odd", unit(5), "b"), (None, unit(dim), "c")]
    queries = [(i, unit(dim)) for i in range(23)] + [(100, unit(3)), (101, None), (102, [0.0] * dim), (103, unit(9))]
    return rows, queries


def _scores(rows, queries):
    for q, w in queries:
        for i, v, label in rows:
            if i is None or not v or w is None or len(v) != len(w) or any(x is None or x != x for x in v):
                continue
            yield q, i, label, float(np.dot(v, w))


@pytest.fixture(params=["one block", "blocks"])
def blocks(request, monkeypatch):
    if request.param == "blocks":  # several passes, several steps a batch, the pool cut again and again
        monkeypatch.setattr(dense, "MOST_QUERIES", 6)
        monkeypatch.setattr(dense, "PAIRS", 50)


def _frames(spark, rows, queries):
    return spark.createDataFrame(rows, "id string, vector array<float>, label string").repartition(5), spark.createDataFrame(queries, "query_id bigint, query_vector array<double>")


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_top_k(spark, blocks, k):
    rows, queries = _data(k)
    got = dense.top_k(*_frames(spark, rows, queries), k, id="id").collect()
    want = {}
    for q, i, _, s in _scores(rows, queries):
        want.setdefault(q, []).append((-round(s, 9), i))
    assert {(r.query_id, r.rank, r.id, round(r.cosine, 9)) for r in got} == {(q, n, i, -s) for q, own in want.items() for n, (s, i) in enumerate(sorted(own)[:k], 1)}


def test_max_pool(spark, blocks):
    rows, queries = _data(9)
    got = dense.max_pool(*_frames(spark, rows, queries), key="label", path="id").collect()
    want = {}
    for q, i, label, s in _scores(rows, queries):
        want[q, label] = min(want.get((q, label), (9, "")), (-round(s, 9), i))
    assert {(r.query_id, r.label): (-round(r.score, 9), r.id) for r in got} == want


def test_candidates(spark, blocks):
    rows, queries = _data(5)
    rows = [r for i, r in enumerate(rows) if r[0] is None or r[0] not in {x[0] for x in rows[:i]}]
    vectors, asked = _frames(spark, rows, queries)
    ids = [(q, r[0]) for q, _ in queries for r in rows[q % 7 :: 7] if r[0]] + [(999, "v1"), (1, "unknown")]
    got = dense.of_candidates(vectors, asked, spark.createDataFrame(ids, "query_id bigint, id string"), id="id").collect()
    want = {(q, i): round(s, 9) for q, i, _, s in _scores(rows, queries) if (q, i) in set(ids)}
    assert {(r.query_id, r.id): round(r.cosine, 9) for r in got if r.cosine == r.cosine} == want


def test_no_queries_or_vectors(spark):
    vectors, queries = _frames(spark, *_data(1))
    assert dense.top_k(vectors, queries.where("false"), 3, id="id").count() == 0
    assert dense.top_k(vectors.where("false"), queries, 3, id="id").count() == 0
    assert dense.max_pool(vectors, queries.where("false"), key="label", path="id").count() == 0


def test_plan_scores_in_blocks(spark):
    """No interpreted lambda scores a pair, and no task hands on more than k rows a query."""
    vectors, queries = _frames(spark, *_data(1))
    plan = dense.top_k(vectors, queries, 3, id="id")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan and "WindowGroupLimit" in plan


def test_platform_numbers_are_not_ids(spark):
    """An image under a platform's number is not of a listing whose id is the same number."""
    from millrace.operators import vectors

    listings = spark.createDataFrame([("5", "100005"), ("100005", "200005"), ("7", None), ("8", "")], "listing_id string, platform_id string")
    paths = ["shots/platform_id=100005/x.jpg", "platform_id=200005/y.jpg", "sred/100005_tile1", "platform_id=7/z.jpg", "platform_id=8/z.jpg", "5", "platform_id=5/x.jpg"]
    images = spark.createDataFrame([(p, [i + 1.0]) for i, p in enumerate(paths)], "path string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<double>")
    assert {(r.listing_id, r.vlm) for r in vectors.score_images(images, queries, listings).collect()} == {("5", 6.0), ("100005", 3.0), ("7", 4.0), ("8", 5.0)}


def test_parts_write_their_result(spark, monkeypatch):
    """Queries that go in several passes leave k rows each, not k rows a task."""
    monkeypatch.setattr(dense, "MOST_QUERIES", 8)
    rows, queries = _data(5)
    vectors, asked = _frames(spark, rows, queries)
    out = dense.top_k(vectors.repartition(6), asked, 3, id="id")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == dense.top_k(vectors, asked, 3, id="id").count() <= 3 * len(queries)
