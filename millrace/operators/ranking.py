"""Fusion of signals, order, explanation and the stage trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.scalars import any_of

ROOM_QUERY = ("wg", "zimmer", "room", "chambre", "camera", "coloc")
ROOM_CATEGORIES = ("WG-Zimmer", "Einzelzimmer")


def fused(signals: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Sum of signal times weight; an unscored signal is 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(signals[k], F.lit(0.0)) * weights[k] for k in V.SIGNALS))


def room_factor(category: Column, query: Column) -> Column:
    """Rooms in shared flats count two fifths unless the query asks for a room."""
    return F.when(category.isin(*ROOM_CATEGORIES) & ~any_of(F.lower(F.coalesce(query, F.lit(""))), ROOM_QUERY), V.ROOM_SHARE_FACTOR).otherwise(1.0)


def top_k(df: DataFrame, k: Column | int, score: str = "score", tie: str = "cand_ord") -> DataFrame:
    """The best k of each query, equal scores in candidate order, with rank from 1 on."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contributions(signals: dict[str, Column], weights: dict[str, Column]) -> Column:
    """(signal, value, share) of every signal, share being value times weight: the largest share first, equals in the signals' order."""
    parts = F.array(*(F.struct((-F.coalesce(signals[k], F.lit(0.0)) * weights[k]).alias("minus"), F.lit(i).alias("at"), F.lit(k).alias("signal"), F.coalesce(signals[k], F.lit(0.0)).alias("value")) for i, k in enumerate(V.SIGNALS)))
    return F.transform(F.array_sort(parts), lambda p: F.struct(p["signal"].alias("signal"), p["value"].alias("value"), (-p["minus"]).alias("share")))


def top_signals(parts: Column, most: int = 3) -> Column:
    """The largest contributions that add to the score."""
    return F.slice(F.filter(parts, lambda p: p["share"] > 0), 1, most)


def reason(parts: Column, most: int = 3) -> Column:
    """`signal=value` of the largest contributions, the raw signal to two decimals."""
    return F.concat_ws(", ", F.transform(F.slice(parts, 1, most), lambda p: F.concat(p["signal"], F.lit("="), F.format_string("%.2f", p["value"]))))


def signal_map(signals: dict[str, Column], digits: int) -> Column:
    return F.create_map(*(x for k, c in signals.items() for x in (F.lit(k), F.round(F.coalesce(c, F.lit(0.0)), digits))))


def result_page(ranked: DataFrame, limit: Column, offset: Column) -> DataFrame:
    """limit cuts the ranked list before offset does: pages shrink, and none is left from limit on."""
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= limit))


def constant_rank(found: DataFrame) -> DataFrame:
    """Rank of the structured path: score 1 in candidate order."""
    w = Window.partitionBy("query_id").orderBy("cand_ord")
    return found.withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(w)).withColumn("reason", F.lit("Matched hard filters; soft ranking stub."))


def stage_trace(stages: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, stage, rows, state): what each stage left of each query; `empty` where it left nothing."""
    counts = reduce(DataFrame.unionByName, (df.groupBy("query_id").agg(F.count("*").alias("rows")).withColumn("stage", F.lit(name)) for name, df in stages.items()))
    grid = queries.select("query_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    return grid.join(counts, ["query_id", "stage"], "left").select("query_id", "stage", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("state"))
