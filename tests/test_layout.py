"""Tables clustered by place: what a search by radius reads of them."""

import glob
import math
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.operators import filters
from millrace.plans.schema import LISTING, intents
from millrace.sources import listings as sources


def _table(spark, n=6000):
    rng = random.Random(1)
    rows = [{"listing_id": str(i), "title": f"t{rng.random()}" * 5, "latitude": None if i % 50 == 0 else rng.uniform(45.8, 47.8), "longitude": rng.uniform(6.0, 10.4)} for i in range(n)]
    return spark.createDataFrame([tuple(r.get(f) for f in LISTING.names) for r in rows], LISTING), rows


def _near(rows, lat, lng, km):
    def apart(r):
        h = math.sin(math.radians(r["latitude"] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(r["latitude"])) * math.sin(math.radians(r["longitude"] - lng) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    return {r["listing_id"] for r in rows if r["latitude"] is not None and apart(r) <= km}


def test_radius_reads_few_row_groups(spark, tmp_path):
    """Of a table by place a fifth of the row groups at most can hold a circle; by city all can. Both give the same rows."""
    df, rows = _table(spark)
    asked = [{"query_id": 1, "latitude": 46.9, "longitude": 7.4, "radius_km": 20.0}, {"query_id": 2, "latitude": 47.4, "longitude": 8.5, "radius_km": 5.0}]
    share = {}
    for cluster in ("place", "city"):
        path = f"{tmp_path}/{cluster}"
        assert sources.bootstrap(df.repartition(8), path, cluster=cluster, row_group_bytes=8192) and not sources.bootstrap(df, path)
        found = filters.matched(spark.read.parquet(path), intents(spark, asked)).select("query_id", "listing_id").collect()
        for a in asked:
            assert {r.listing_id for r in found if r.query_id == a["query_id"]} == _near(rows, a["latitude"], a["longitude"], a["radius_km"])
        groups = hit = 0
        for name in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(name).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                lat, lng = (meta.row_group(g).column(at[c]).statistics for c in ("latitude", "longitude"))
                groups += 1
                hit += lat.has_min_max and any(lat.max >= a["latitude"] - a["radius_km"] / 111 and lat.min <= a["latitude"] + a["radius_km"] / 111 and lng.max >= a["longitude"] - a["radius_km"] / 70 and lng.min <= a["longitude"] + a["radius_km"] / 70 for a in asked)
        share[cluster] = hit / groups
        assert groups >= 16
    assert share["place"] <= 0.2 and share["city"] >= 0.9


def test_ranges_reach_the_scan(spark, tmp_path):
    df, _ = _table(spark, 100)
    df.write.parquet(f"{tmp_path}/t")
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = lambda *asked: filters.matched(spark.read.parquet(f"{tmp_path}/t"), intents(spark, list(asked)))._jdf.queryExecution().executedPlan().toString()
    circle = {"query_id": 1, "latitude": 46.9, "longitude": 7.4, "radius_km": 20.0}
    try:
        assert "GreaterThanOrEqual(latitude" in plan(circle) and "LessThanOrEqual(longitude" in plan(circle)
        # An intent without a place asks for all.
        assert "GreaterThanOrEqual(latitude" not in plan(circle, {"query_id": 2})
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)


def test_boxes_hold_their_circles(spark):
    rng = random.Random(3)
    circles = [(rng.uniform(-89, 89), rng.uniform(-170, 170), rng.uniform(1, 400)) for _ in range(50)]
    points = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)] + [(a + rng.uniform(-2, 2), b + rng.uniform(-2, 2)) for a, b, _ in circles for _ in range(20)], "latitude double, longitude double")
    for some in (circles[:1], circles[:10], circles):
        inside = F.lit(False)
        for a, b, km in some:
            inside = inside | (geo.in_box(F.col("latitude"), F.col("longitude"), F.lit(a), F.lit(b), F.lit(km)) & (geo.distance_km(F.lit(a), F.lit(b), F.col("latitude"), F.col("longitude")) <= km))
        assert points.where(inside & ~geo.boxes(some, F.col("latitude"), F.col("longitude"))).count() == 0


def test_place_codes_keep_near_places_together(spark):
    df = spark.range(4096).select((F.col("id") % 64 / 64 * 180 - 90).alias("a"), (F.floor(F.col("id") / 64) / 64 * 360 - 180).alias("b"))
    codes = [r.c for r in df.select(geo.place_code(F.col("a"), F.col("b")).alias("c")).collect()]
    assert len(set(codes)) == 4096 and 0 <= min(codes) and max(codes) < 1 << 32
    assert spark.range(1).select(geo.place_code(F.lit(None).cast("double"), F.lit(1.0)).alias("c")).first().c is None
