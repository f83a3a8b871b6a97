"""Samples by strata against plain sorting."""

import random

from pyspark.sql import functions as F

from millrace.operators import evaluate


def test_bottom_k(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.random(), f"x{i}") for i in range(2000)] + [(3000, "one", 0.5, None)]
    df = spark.createDataFrame(rows, "id bigint, s string, o double, rest string").repartition(7)
    for n in (1, 5, 300):
        want = {r for s in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == s), key=lambda r: r[2])[:n]}
        assert {tuple(r) for r in evaluate.bottom_k(df, "s", n, "o").collect()} == want
    assert evaluate.bottom_k(df.where("false"), "s", 3, "o").count() == 0


def test_strata_are_not_sorted_whole(spark):
    """What meets is n rows a stratum and task, whatever the table's size."""
    df = spark.range(100_000).withColumn("s", F.col("id") % 3).repartition(8)
    found = df.mapInArrow(evaluate._lowest([1], 0, 4), df.schema)
    assert found.count() <= 8 * 3 * 4
    out = evaluate.stratified_sample(df, "s", 10, F.col("id")).collect()
    assert sorted(r.id for r in out) == list(range(10))


def test_ties_fall_alike_however_rows_lie(spark):
    """Equal rows are drawn by the named columns, and rows without an order come last."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(500)] + [(1000 + i, "c", None) for i in range(3)] + [(2000, "c", 4)]
    for n in (3, 7, 40):
        held = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[2] is None, r[2] or 0, r[0])) for s in ("a", "b", "c", None)}
        placed = sorted((i >= n // 3, r[2] is None, r[2] or 0, r[0]) for own in held.values() for i, r in enumerate(own[:n]))
        for parts in (1, 5):
            own = spark.createDataFrame(rng.sample(rows, len(rows)), "id bigint, s string, o int").repartition(parts)
            assert sorted(r.id for r in evaluate.stratified_sample(own, "s", n, F.col("o"), ("id",)).collect()) == sorted(p[3] for p in placed[:n])
