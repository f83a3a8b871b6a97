"""Intents by text, kept: each text is understood once, however often it is asked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.scalars import strip
from millrace.operators.intent import understand
from millrace.sources.segments import SegmentLog


class IntentCache:
    """Texts and what was understood of them, a segment for each batch that brought new ones.

    parse takes (query_id, raw_query) and adds the intent's fields; whatever it is, its results stay until invalidate().
    """

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame] = understand):
        self.spark, self.log, self.parse = spark, SegmentLog(spark, path), parse

    def _known(self, segments: list[str]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(self.log.folder(s)) for s in segments)) if segments else None

    def understand(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, raw_query and others) with the fields of their intents. Texts are trimmed; null and empty ones ask for nothing: all fields are null.

        Distinct new texts are understood and written while the plan is built.
        """
        asked = queries.withColumn("raw_query", F.coalesce(strip(F.col("raw_query")), F.lit("")))
        texts = asked.select("raw_query").where("raw_query <> ''").distinct()
        version, segments, _ = self.log.read()
        known = self._known(segments)
        new = texts if known is None else texts.join(known.select("raw_query"), "raw_query", "left_anti")
        name = self.log.new_segment()
        # An id for each text only while it is understood.
        self.parse(new.select(F.xxhash64("raw_query").alias("query_id"), "raw_query")).drop("query_id").write.parquet(self.log.folder(name))
        if self.spark.read.parquet(self.log.folder(name)).take(1) or known is None:
            segments = [*segments, name]
            self.log.commit(version, segments)
        held = self._known(segments)
        return asked.join(held, "raw_query", "left").select(*queries.columns, *(c for c in held.columns if c not in queries.columns))

    def invalidate(self) -> int:
        """The new version, in which nothing is known."""
        return self.log.commit(self.log.read()[0], [])


def soft_facts(intents: DataFrame) -> DataFrame:
    """query_id, raw_query, language, used_llm and soft: what a query would like, beside its hard bounds; flags that were not said are false."""
    said = {("parking" if f == "soft_parking" else f): F.coalesce(F.col(f), F.lit(False)) for f in (f"soft_{k}" if k == "parking" else k for k in V.SOFT_KEYWORDS)}
    own = [*(c.alias(f) for f, c in said.items()), *(F.col(c) for c in ("descriptors", "price_intent", "anchors", "weights"))]
    return intents.select("query_id", "raw_query", F.coalesce("language", F.lit("unknown")).alias("language"), F.lit(False).alias("used_llm"), F.struct(*own).alias("soft"))
