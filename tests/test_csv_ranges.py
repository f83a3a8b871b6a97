"""CSV by ranges of bytes against Spark's own reader, which takes a file a task."""

import csv
import random

import pytest
from pyspark.sql import types as T

from millrace.sources import listings
from millrace.sources.csv_ranges import read_csv_ranges

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "text")])


def _files(tmp_path, seed, newline="\n"):
    rng = random.Random(seed)
    rows = []
    for name in ("a", "b"):
        with open(f"{tmp_path}/{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerow(["id", "title", "text"])
            for i in range(120):
                words = ["w", 'say ""', '"', "a,b", "é\n", "\n\n", "line\nbreak", "x" * 50, '"\n"', ""]
                row = [f"{name}{i}", rng.choice(words) + "t", "".join(rng.choices(words, k=rng.randint(1, 40))) + "."]
                out.writerow(row)
                rows.append(tuple(row))
    return sorted(rows)


@pytest.mark.parametrize(("seed", "size", "newline"), [(1, 300, "\n"), (2, 64, "\n"), (3, 1000, "\r\n"), (4, 10_000_000, "\n")])
def test_ranges(spark, tmp_path, seed, size, newline):
    """Ranges so small that records, and runs of lines inside quotes, go over one edge or several."""
    want = _files(tmp_path, seed, newline)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = read_csv_ranges(spark, str(tmp_path), SCHEMA)
        got = sorted(tuple(r) for r in df.collect())
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert got == sorted(tuple(r) for r in listings.read_csv(spark, str(tmp_path), SCHEMA).collect())
    assert tasks > 20 if size < 5000 else tasks >= 1


def test_only_a_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,title,text\n")
    assert read_csv_ranges(spark, str(tmp_path), SCHEMA).count() == 0
