"""Merkle manifests against a plain version."""

import random

import pytest
from plain_merkle import manifest, sha, tree
from pyspark.sql import functions as F

from millrace.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _rows(spark, tmp_path, rows, parts=3):
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, path).collect()
    return sorted((tuple(r) for r in got), key=lambda x: tuple((y is not None, y) for y in x))


def _want(rows):
    return manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])


@pytest.mark.parametrize("sizes", [(1,), (2,), (8,), (9,), (64, 1), (65, 8, 7, 3), (513, 1, 1, 1, 1, 1, 1, 1, 1, 17)])
def test_sizes(spark, tmp_path, sizes):
    """Trees of one to four levels, and over one to ten languages."""
    rows = [(1000 * k + i, f"Some Text {i} É", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert _rows(spark, tmp_path, rows) == _want(rows)


def test_edges(spark, tmp_path):
    """Nulls in each column, empty and long texts, repeated ids and rows, languages out of code point order."""
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (1, "", "en", "", 0), (1, "Ab", "en", "s", 2), (1, "Ab", "en", "s", 2), (2, None, "en", "s", 2), (3, "XÉ" * 300_000, "de", "s", 9), (5, "Q", "", "s", 1), (6, "Q", "é", "s", 1), (7, "Q", "\U00010400", "s", 1), (8, "Q", "￮", "s", 1), (-4, "low", "en", "s", 3)]
    rows += [(9, "Same", "fr", "s", 4)] * 40
    assert _rows(spark, tmp_path, rows) == _want(rows)


def test_empty(spark, tmp_path):
    assert _rows(spark, tmp_path, []) == []


def test_clashing_names_and_paths(spark):
    """Columns named as the operator's own stay apart; any leaf's path leads to the root."""
    leaves = [sha(str(i)) for i in range(70)]
    df = spark.createDataFrame([(i, "a", leaves[i], i % 7, "x", i) for i in range(70)], "nth int, group string, digest string, size int, path string, run int")
    out = merkle.manifest(df.withColumnRenamed("path", "own"), group="group", order=["nth"], digest="digest", carry=["nth", "digest", "size", "run", "own"])
    assert out.columns == ["nth", "digest", "size", "run", "own", "subroot", "root", "path"]
    root, paths = tree(leaves)
    got = out.withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    assert len(got) == 70
    for r in got:
        assert (r.root, r.folded, r.size) == (root, root, r.nth % 7)
        assert [(s.left, s.right) for s in r.path] == paths[r.nth]
