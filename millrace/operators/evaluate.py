"""Evaluation of rankings and analytics of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(judged: DataFrame, by: list[str], rank: str = "rank", score: str = "score") -> DataFrame:
    """nDCG of each list: gains over log2(rank + 1), against the same scores in the best order; 0 without gain."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), rank)
    placed = judged.withColumn("best", F.row_number().over(w))
    gain = lambda at: F.sum(F.col(score).cast("double") / F.log2(F.col(at) + F.lit(1)))
    sums = placed.groupBy(*by).agg(gain(rank).alias("dcg"), gain("best").alias("ideal"))
    return sums.select(*by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def judge_metrics(judged: DataFrame, per_query: DataFrame, by: list[str]) -> DataFrame:
    """Of scores: mean, share from 3 and from 4 up; of queries: mean nDCG; to three decimals. by empty: over all."""
    scores = judged.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.round(F.avg((F.col("score") >= 3).cast("double")), 3).alias("share_3"), F.round(F.avg((F.col("score") >= 4).cast("double")), 3).alias("share_4"))
    lists = per_query.groupBy(*by).agg(F.round(F.avg("ndcg"), 3).alias("mean_ndcg"))
    return scores.join(lists, by) if by else scores.join(F.broadcast(lists), how="cross")  # one row each


def judge_rollup(judged: DataFrame, per_query: DataFrame, by: str) -> DataFrame:
    """judge_metrics of each value of by and, under a null one, over all."""
    return judge_metrics(judged, per_query, [by]).unionByName(judge_metrics(judged, per_query, []).withColumn(by, F.lit(None).cast(judged.schema[by].dataType)))


def join_judgements(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with the scores that came back under their custom_id; unknown ids are dropped."""
    return requests.join(results, "custom_id")


def _lowest(by: list[int], order: int, n: int, ties: tuple[int, ...] = ()):
    """Of a stream of Arrow batches the n rows of each stratum that come first by a column, then by columns ties, nulls last; no more are held than those and a batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if held is None else pa.concat_tables([held, own])
            names = own.schema.names
            ranked = own.take(pc.sort_indices(own, sort_keys=[(names[i], "ascending") for i in (*by, order, *ties)]))
            if len(ranked):
                edge = np.zeros(len(ranked), dtype=bool)
                edge[0] = True
                for i in by:
                    code = ranked.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    edge[1:] |= code[1:] != code[:-1]
                first = np.maximum.accumulate(np.where(edge, np.arange(len(ranked)), 0))
                ranked = ranked.filter(pa.array(np.arange(len(ranked)) - first < n))
            held = ranked
        if held is not None:
            yield from held.to_batches()

    return run


def bottom_k(df: DataFrame, stratum: str, n: int, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of each stratum that come first by a column, equals by ties: in each task, then of what tasks found. No task sees a stratum."""
    by, at, then = [df.columns.index(stratum)], df.columns.index(order), tuple(map(df.columns.index, ties))
    found = df.mapInArrow(_lowest(by, at, n, then), df.schema)
    # n rows a stratum and task at most, streamed through the same heap.
    return found.repartition(F.col(stratum)).mapInArrow(_lowest(by, at, n, then), df.schema)


def stratified_sample(df: DataFrame, stratum: str, n: int, order: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """n rows: an equal share of each stratum by order, then more by order until there are n. Stratum shares come first. Nulls are a stratum of their own without a share of n.

    Rows that are equal by order stand by the columns ties, nulls of both last; what those leave equal is drawn as it lies in the partitions.
    """
    lowest = bottom_k(df.withColumn("_o", order), stratum, n, "_o", ties)
    by_order = [F.col(c).asc_nulls_last() for c in ("_o", *ties)]
    per = Window.partitionBy(stratum).orderBy(*by_order)  # n rows at most
    strata = lowest.agg(F.count_distinct(stratum).alias("_s"))
    placed = lowest.withColumn("_r", F.row_number().over(per)).join(F.broadcast(strata), how="cross").withColumn("_first", F.col("_r") <= F.floor(F.lit(n) / F.col("_s")))  # one row
    return placed.orderBy(F.desc("_first"), *by_order).limit(n).select(*df.columns)


def counts_by(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def price_stats(listings: DataFrame, by: str) -> DataFrame:
    return listings.groupBy(by).agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("rooms").alias("avg_rooms"))


def coverage(listings: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have each flag set, unset, and unknown."""
    return listings.agg(*(e for c in columns for e in (F.count_if(F.col(c) == 1).alias(f"{c}_yes"), F.count_if(F.col(c) == 0).alias(f"{c}_no"), F.count_if(F.col(c).isNull()).alias(f"{c}_unknown"))))
