"""Points of interest, image stores, object listings and JSON results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import file_slug

ELEMENT = "type string, lat double, lon double, center struct<lat:double,lon:double>, tags struct<name:string,amenity:string,highway:string,railway:string,shop:string>"

_own: list[str] = []  # this process's temporary folder


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the folder that driver and executors share; a local master without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = f"file://{_own[0]}"
    path = f"{shared}/millrace/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written to a folder of its own and read back, so that nothing computes it again; it goes when the application ends."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_poi_cache(spark: SparkSession, path: str, poi_type: str) -> DataFrame:
    """Elements of one type's JSON cache, a list or an object with `elements`."""
    text = spark.read.text(path, wholetext=True).select("value")
    items = F.coalesce(F.from_json("value", f"elements array<struct<{ELEMENT.replace(' double', ':double').replace(' string', ':string').replace(' struct', ':struct')}>>")["elements"], F.from_json("value", f"array<struct<{ELEMENT.replace(' double', ':double').replace(' string', ':string').replace(' struct', ':struct')}>>"))
    return text.select(F.explode(items).alias("e")).select("e.*").withColumn("poi_type", F.lit(poi_type))


def pending_tiles(images: DataFrame, done: DataFrame, tiles: int = 4) -> DataFrame:
    """(path, tile): images still to be embedded: .jpg as they are, tiles of each .jpeg under sred/; paths done are skipped."""
    tiled = F.startswith("path", F.lit("sred/")) & F.endswith("path", F.lit(".jpeg"))
    rows = images.where(tiled | F.endswith("path", F.lit(".jpg"))).select("path", F.explode(F.when(tiled, F.sequence(F.lit(0), F.lit(tiles - 1))).otherwise(F.array(F.lit(None).cast("int")))).alias("tile"))
    keyed = rows.withColumn("out_path", F.when(F.col("tile").isNull(), F.col("path")).otherwise(F.concat(F.regexp_replace("path", r"\.jpeg$", ""), F.lit("_tile"), F.col("tile").cast("string"))))
    return keyed.join(done.select(F.col("path").alias("out_path")), "out_path", "left_anti")


def write_shards(df: DataFrame, path: str, shard_size: int = 1024) -> None:
    df.write.option("maxRecordsPerFile", shard_size).mode("append").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("vector", F.col("vector").cast("array<float>"))


def encoded_key(key: Column) -> Column:
    """Percent-encoded segment by segment: slashes stay, a blank is %20."""
    return F.array_join(F.transform(F.split(key, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def image_objects(objects: DataFrame, base_url: str) -> DataFrame:
    """(listing_id, urls) of a bucket's image objects (key `…/listing/file`), in key order."""
    rows = objects.where(F.lower("key").rlike(r"\.(jpg|jpeg|png|webp)$")).select(F.element_at(F.split("key", "/"), -2).alias("listing_id"), "key", F.concat(F.lit(base_url.rstrip("/") + "/"), encoded_key(F.col("key"))).alias("url"))
    return rows.groupBy("listing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "url"))), lambda x: x["url"]).alias("urls"))  # a listing's pictures


def result_name(query: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), file_slug(query), F.lit(".json"))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line a query, a folder for each."""
    results.write.mode("append").partitionBy("query_id").json(path)
