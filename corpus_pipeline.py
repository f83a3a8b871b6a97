"""From raw documents to packed sequences: five stages, each one operator of millrace.llm.

Each stage reads what the stage before wrote. run() writes each stage's result
as Parquet to the shared folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import packing, quality_gam, quality_rules, similar, suffix_dedup
from millrace.llm.base import discard, held_out, materialize, scratch, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or look anomalous go; null, empty and very short texts fail."""
    return quality_rules.keep_passing(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"), ~held_out()))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores under a half go. It learns from the labelled ones of all documents: those that earlier stages left may bear one label only."""
    known = quality_gam.labelled_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return quality_gam.keep_good(docs, quality_gam.fit(*known))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash over five-word shingles and a similarity of 0.8 or more, the document with the smallest id stays."""
    return similar.keep_first(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut out of the text; documents with nothing left go."""
    return suffix_dedup.cut_later(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Forests, boosted tables, XXH64 and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as keep:  # what a stage writes on its way goes with it
            before, docs = docs, keep(materialize(stage(spark, docs, sf_dir)))
        discard(before)
    return docs
