"""Indexes that grow and searches by bounds, against a full build and a full search."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import bm25, bm25_blocks, bm25_store

WORDS = [f"w{i}" for i in range(40)]


def _docs(rng, ids):
    return {i: " ".join(rng.choices(WORDS, weights=[1 / (1 + n) for n in range(40)], k=rng.choice((0, 1, 5, 30)))) for i in ids}


def _frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")


def _told(index):
    n = index.corpus.first()
    return (
        {(r.doc_id, r.term, r.tf) for r in index.postings.collect()},
        {(r.doc_id, r.dl) for r in index.docs.collect()},
        {(r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()},
        (n.n, round(n.avgdl, 9)),
    )


def test_store_equals_full_build(spark, tmp_path, monkeypatch):
    """Additions, replacements, deletions, ids that come again, compaction when segments are many; each version as a full build."""
    monkeypatch.setattr(bm25_store, "MOST_SEGMENTS", 3)
    rng = random.Random(8)
    store, now, states = bm25_store.Bm25Store(spark, str(tmp_path)), {}, {}
    for step in range(6):
        if step % 3 == 2:
            ids = rng.sample(range(40), 10)
            version = store.delete(spark.createDataFrame([(i,) for i in ids] + [(None,), (999,)], "doc_id bigint"))
            now = {k: v for k, v in now.items() if k not in ids}
        else:
            new = _docs(rng, rng.sample(range(40), 15))
            version = store.add(_frame(spark, new), id="doc_id", text="text")
            now = now | new
        states[version] = dict(now)
    last = store.compact()
    states[last] = dict(now)
    for version, docs in states.items():
        want = _told(bm25.build_index(_frame(spark, docs), id="doc_id", text="text"))
        assert _told(bm25_store.Bm25Store(spark, str(tmp_path)).index(version)) == want
    store.vacuum()
    assert store.log.versions() == [last]


def test_empty_store(spark, tmp_path):
    store = bm25_store.Bm25Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.index()
    assert store.delete(spark.createDataFrame([(1,)], "doc_id bigint")) == 0


@pytest.mark.parametrize(("k", "block"), [(1, 4), (5, 16), (500, 16)])
def test_bounded_search(spark, k, block):
    """The same rows as a search that opens everything, and less opened."""
    rng = random.Random(k)
    docs = _docs(rng, range(300)) | {400 + i: "w0 w1 w2" for i in range(20)}  # ties
    index = bm25.build_index(_frame(spark, docs), id="doc_id", text="text")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for i in range(30)] + [(50, "w0 w0 w39"), (51, "unknown"), (52, ""), (53, None), (54, "w0 w1 w2")], "query_id bigint, raw_query string")
    search = bm25_blocks.Search(bm25_blocks.BlockIndex.build(index, block=block), asked, k)
    rows = lambda df: {(r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect()}
    assert rows(search.found()) == rows(bm25.search(index, asked, k))
    work = search.work().agg(F.sum("read").alias("read"), F.sum("postings").alias("postings")).first()
    assert work.read < 0.9 * work.postings if k == 1 else work.read <= work.postings


def test_bounded_search_opens_little(spark):
    """Texts that documents hold close most blocks of common words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = bm25_blocks.BlockIndex.build(bm25.build_index(docs, id="doc_id", text="text"), block=16)
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    work = bm25_blocks.Search(index, asked, 10).work().agg(F.sum("read").alias("read"), F.sum("postings").alias("postings")).first()
    assert work.read < work.postings


def test_many_terms_are_not_broadcast(spark):
    asked = spark.createDataFrame([(i, f"t{i}", 1) for i in range(9)], "query_id bigint, term string, times bigint")
    plan = lambda most: bm25.sent(asked, most)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(9) or "UnresolvedHint" in plan(9)
    assert "Hint" not in plan(8)


def test_queries_of_the_same_words_are_one(spark, monkeypatch):
    """Each is answered as if alone, and the words are scored once."""
    rng = random.Random(3)
    index = bm25.build_index(_frame(spark, _docs(rng, range(120))), id="doc_id", text="text")
    texts = ["w0 w1 w1", "w1 w0 w1", "w0 w1", "w39", "unknown", "", None]
    asked = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(50)], "query_id bigint, raw_query string")
    want = {tuple(r) for r in bm25.best(bm25.score(index, asked), 7).collect()}
    sent, seen = bm25.sent, []
    monkeypatch.setattr(bm25, "sent", lambda df, most=None: seen.append(df.select("query_id").distinct().count()) or sent(df, most))
    got = bm25.search(index, asked, 7)
    assert {tuple(r) for r in got.collect()} == want and seen == [4]


def test_bounded_search_scores_in_tasks(spark, monkeypatch):
    """Blocks are scored where they meet, whatever the batches and the parts of the queries: no pair of query and document is joined."""
    monkeypatch.setattr(bm25_blocks, "MOST_QUERIES", 7)
    rng = random.Random(12)
    docs = {f"d{i}": t for i, t in _docs(rng, range(200)).items()}
    index = bm25.build_index(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), id="doc_id", text="text")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(30)], "query_id int, raw_query string")
    rows = lambda df: {(r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect()}
    want = rows(bm25.search(index, asked, 4))
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        search = bm25_blocks.Search(bm25_blocks.BlockIndex.build(index, block=8), asked, 4)
        assert rows(search.found()) == want
        assert "Join" not in search.found()._jdf.queryExecution().optimizedPlan().toString()
        none = bm25_blocks.Search(bm25_blocks.BlockIndex.build(index, block=8), asked.where("query_id < 0"), 4)
        assert none.found().count() == none.work().count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
