"""The pipeline over odd rows and over empty tables."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _write(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, empty texts, a repeated id, exact copies, a very long text, clashing columns: each has its defined end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where(F.length("text").between(800, 5000)).orderBy("doc_id").select(docs.columns).limit(2).collect()
    a, b = good[0].asDict(), good[1].asDict()
    odd = [a | {"doc_id": 900_001}, a | {"doc_id": 900_001}, b | {"doc_id": None}, a | {"doc_id": 900_002, "text": None}, a | {"doc_id": 900_003, "text": ""}, a | {"doc_id": 900_004, "text": " \n"}, b | {"doc_id": 900_005, "lang": None, "source": None, "n_chars": None}, b | {"doc_id": 900_006, "text": (b["text"] + "\n") * 300}]
    own = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x")).withColumn("text_", F.lit(1)).withColumn("H", F.lit(2))
    _write(spark, str(tmp_path), own, spark.read.parquet(f"{SF}/labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    ids = {r.doc_id for r in rows}
    assert all(r.n % r.whole == 0 for r in rows)  # each piece of a kept document is packed once, repeated rows each on their own
    assert a["doc_id"] in ids and not ids & {900_001, 900_002, 900_003, 900_004, 900_005}


def test_empty_tables(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet").where("false") for n in ("documents", "labels"))
    _write(spark, str(tmp_path), docs, labels)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
