"""What a caller asks for, each a function from tables to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bm25, events, geojoin, intent
from millrace.plans import search as plans
from millrace.plans.schema import INTENT, intents


def search_text(listings: DataFrame, queries: DataFrame, index: bm25.Bm25Index, store: DataFrame | None = None, images: DataFrame | None = None, *, limit: int = 25, offset: int = 0) -> DataFrame:
    """Free-text search: queries (query_id, raw_query) by rule into intents, then explained results, limit of them less offset."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    known = intent.understand(queries).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})
    full = known.select(*((F.col(f.name) if f.name in known.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INTENT.fields))
    return plans.search(listings, full, index, store, images)


def search_intents(listings: DataFrame, asked: DataFrame, index: bm25.Bm25Index, store: DataFrame | None = None, images: DataFrame | None = None, **options) -> DataFrame:
    """Search by intents from elsewhere, set right first: canonical cities, postal codes of districts, derived weights."""
    return plans.search(listings, intent.assemble(asked), index, store, images, **options)


def search_filters(spark: SparkSession, listings: DataFrame, filters: list[dict]) -> DataFrame:
    """Structured search: one dict of hard filters a query."""
    return plans.filter_search(listings, intents(spark, [{"query_id": i} | f for i, f in enumerate(filters, 1)]))


def nearby(spark: SparkSession, points: list[tuple[float, float]], pois: DataFrame, k: int = 5, radius_m: float = 2000.0) -> DataFrame:
    """The k nearest points of interest of each point within the radius."""
    own = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points, 1)], "point_id bigint, latitude double, longitude double")
    return geojoin.k_nearest(own, pois, k, radius_m)


def log_events(rows: DataFrame, path: str) -> None:
    events.append(rows, path)


def session_events(log: DataFrame, session_id: str, n: int = 20) -> DataFrame:
    return events.recent_events(log.where(F.col("session_id") == session_id), n)


def map_points(results: DataFrame, listings: DataFrame) -> DataFrame:
    """Results that have coordinates, with their pictures once each: the view of a map."""
    shown = listings.where("latitude is not null and longitude is not null").select("listing_id", "latitude", "longitude", *((F.array_distinct(F.col("image_urls")).alias("image_urls"),) if "image_urls" in listings.columns else ()))
    return results.join(shown, "listing_id")


def display_rows(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """Short rows for listing_ids."""
    return listings.join(ids.select("listing_id"), "listing_id", "left_semi").select("listing_id", "title", "city", "canton", "price", "rooms", "area")


def result_json(results: DataFrame) -> DataFrame:
    """Each result as a JSON text, nulls kept."""
    return results.select("query_id", F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))
