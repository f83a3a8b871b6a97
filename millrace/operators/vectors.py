"""Dense and image vectors: normalising, feedback, hybrid fusion, upkeep; dense.py has the search itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import dense


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v.cast("array<double>"), lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def checked(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has dim components, none of them null."""
    return df.where((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))


def mean_vector(df: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """(by, mean): component by component; partial sums meet, not vectors."""
    parts = df.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))  # one entry a dimension


def blend(query: Column, clicked: Column, share: float) -> Column:
    """The query's unit vector moved by share towards the clicked mean; unmoved without clicks."""
    mixed = unit(F.zip_with(query.cast("array<double>"), clicked, lambda a, b: (1 - share) * a + share * b))
    return F.when(clicked.isNotNull(), mixed).otherwise(query.cast("array<double>"))


def hybrid(dense: DataFrame, lexical: DataFrame, alpha: float, *, id: str = "listing_id") -> DataFrame:
    """alpha times dense plus the rest times lexical, a full outer join of two lists (query_id, id, score) as shares of their largest."""
    by = Window.partitionBy("query_id")
    share = lambda df, name: df.select("query_id", id, F.when(F.max("score").over(by) > 0, F.col("score") / F.max("score").over(by)).otherwise(F.col("score")).alias(name))
    both = share(dense, "d").join(share(lexical, "l"), ["query_id", id], "full_outer")
    return both.select("query_id", id, (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))).alias("score"))


def backlog(listings: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """Listings without a vector of the model."""
    return listings.join(store.where(F.col("model_id") == model), "listing_id", "left_anti")


def upsert(store: DataFrame, rows: DataFrame, key: str = "listing_id") -> DataFrame:
    """The store with rows in place of those of the same key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def fetch(store: DataFrame, ids: DataFrame, model: str | None = None, key: str = "listing_id") -> DataFrame:
    own = store if model is None else store.where(F.col("model_id") == model)
    return own.join(ids.select(key), key, "left_semi")


def count_vectors(store: DataFrame, model: str) -> DataFrame:
    return store.where(F.col("model_id") == model).agg(F.count("*").alias("n"))


def shard_keys(listings: DataFrame) -> DataFrame:
    """(shard_key, listing_id): the keys under which a listing's images may lie: its platform's number, `sred_` and its id, or the bare id."""
    keys = F.array_distinct(F.array_compact(F.array(F.nullif("platform_id", F.lit("")), F.concat(F.lit("sred_"), F.col("listing_id")), F.col("listing_id"))))
    return listings.select(F.explode(keys).alias("shard_key"), "listing_id")


def _image_keys(listings: DataFrame) -> DataFrame:
    """(image_key, listing_id): the keys of shard_keys(), with the platform's number also as paths name it."""
    own = F.nullif("platform_id", F.lit(""))
    keys = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("platform_id="), F.coalesce(own, "listing_id")), F.concat(F.lit("sred_"), F.col("listing_id")), own, F.col("listing_id"))))
    return listings.select(F.explode(keys).alias("image_key"), "listing_id")


def score_images(images: DataFrame, queries: DataFrame, listings: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, listing_id, vlm): a listing's best image for each query; images (path, vector) lie under any of a listing's keys.

    Numbers of platforms and ids of listings may be the same: what lies under `platform_id=` is of the listing with that number
    at its platform, and of one with that id only if it has no such number.
    """
    from millrace.functions.scalars import image_key

    keyed = images.withColumn("image_key", image_key(F.col("path"))).join(_image_keys(listings), "image_key").drop("image_key")
    if candidates is not None:
        keyed = keyed.join(candidates.select("listing_id").distinct(), "listing_id", "left_semi")
    if candidates is None:
        return dense.max_pool(keyed, queries, key="listing_id", path="path").select("query_id", "listing_id", F.col("score").alias("vlm"))
    scored = dense.of_candidates(keyed, queries, candidates)
    return scored.groupBy("query_id", "listing_id").agg(F.max("cosine").alias("vlm"))
