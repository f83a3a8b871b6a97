"""Raw listings: scan, foreign sources, typing, sink, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S
from millrace.functions import values as V
from millrace.functions.geo import place_code
from millrace.sources.csv_ranges import read_csv_ranges

RAW = T.StructType([T.StructField(c, T.StringType()) for c in V.RAW_COLUMNS])
FOREIGN = T.StructType([T.StructField(c, T.StringType()) for c in ("listing_id", "header", "ad_description", "price", "living_space", "rooms", "lat", "lon")])
IMAGE_SUFFIXES = (".jpeg", ".jpg", ".png", ".webp")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW, by_ranges: bool = False) -> DataFrame:
    """All strings: quoted fields may hold line breaks and doubled quotes. A folder or a pattern reads as the union of its files.

    A file is one task, unless it is read by ranges: then texts are read twice, in as many tasks as there are ranges.
    """
    if by_ranges:
        return read_csv_ranges(spark, path, schema)
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(listing_id, file): for each id the first of its files by suffix order; contents are not read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return pick_image(paths)


def pick_image(paths: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    order = F.array_position(F.array(*map(F.lit, IMAGE_SUFFIXES)), suffix)
    rows = paths.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("listing_id"), name.alias("file"), order.alias("o")).where("o > 0")
    return rows.groupBy("listing_id").agg(F.min_by("file", "o").alias("file"))


def normalise_foreign(splits: dict[str, DataFrame], images: DataFrame | None = None, source: str = "SRED") -> DataFrame:
    """Splits of a foreign source, one after another, under the 52 raw columns."""
    out = None
    for split, df in splits.items():
        own = df.withColumn("_id", S.listing_id(F.col("listing_id")))
        own = own.join(images.select(F.col("listing_id").alias("_id"), "file"), "_id", "left") if images is not None else own.withColumn("file", F.lit(None).cast("string"))
        url = F.concat(F.lit("/raw-data-images/"), F.col("file"))
        text = F.coalesce("ad_description", F.lit(""))
        payload = F.to_json(F.struct(F.lit(source.lower()).alias("source"), F.lit(split).alias("split"), F.col("_id").alias("listing_id"), url.alias("image_url"), F.struct(*df.columns).alias("raw_row")), {"ignoreNullFields": "false"})
        title = F.coalesce(F.nullif(S.strip(F.coalesce("header", F.lit(""))), F.lit("")), F.concat(F.lit(f"{source} listing "), F.col("_id")))
        found = F.when(F.col("file").isNotNull(), F.to_json(F.struct(F.array(F.struct(url.alias("url"), F.col("file").alias("filename"))).alias("images")))).otherwise('{"images": []}')
        given = {
            "id": F.col("_id"), "platform_id": F.col("_id"), "title": title, "price": F.coalesce("price", F.lit("")), "location_address": F.lit("{}"), "partner_name": F.lit(source), "remarks": text, "orig_data": payload, "images": found,
            "area": F.coalesce("living_space", F.lit("")), "offer_type": F.lit("RENT"), "number_of_rooms": F.coalesce("rooms", F.lit("")), "object_description": text, "geo_lat": F.coalesce("lat", F.lit("")), "geo_lng": F.coalesce("lon", F.lit("")), "scrape_source": F.lit(source), "rent_gross": F.coalesce("price", F.lit("")),
        }
        rows = own.select(*(given.get(c, F.lit("")).alias(c) for c in V.RAW_COLUMNS))
        out = rows if out is None else out.unionByName(rows)
    return out


_PAIRS = "array<struct<Key:string,Value:string>>"


class _Extra:
    """Flags of a listing's original payload: its feature list and its main data."""

    def __init__(self, orig_data: Column):
        text = S.clean_text(orig_data)
        own = F.from_json(text, f"Features {_PAIRS}, MainData {_PAIRS}")
        self.features, self.main = own["Features"], own["MainData"]
        # A feature without a value counts as present; one whose value is null does not.
        raw = F.from_json(text, "Features array<string>")["Features"]
        self.enabled = F.transform(F.filter(raw, lambda x: F.coalesce(S.truthy(F.get_json_object(x, "$.Value")), F.lit(False)) | ~F.contains(x, F.lit('"Value"'))), lambda x: F.get_json_object(x, "$.Key"))

    def listed(self, *keys: str) -> Column:
        """True if a key is enabled, false if the list is there, else null."""
        return F.when(self.features.isNotNull(), F.coalesce(F.arrays_overlap(self.enabled, F.array(*map(F.lit, keys))), F.lit(False)))

    def main_flag(self, *keys: str) -> Column:
        """By the first key present, the last of its entries; false if none is, null without main data."""
        last = lambda k: F.try_element_at(F.filter(self.main, lambda e: e["Key"] == k), F.lit(-1))
        return F.when(self.main.isNotNull(), F.coalesce(*(F.when(last(k).isNotNull(), S.truthy(last(k)["Value"])) for k in keys), F.lit(False)))


def feature_flags() -> dict[str, Column]:
    """The twelve features of a raw row, each true, false or unknown."""
    x = _Extra(F.col("orig_data"))
    b = lambda c: S.parse_bool(F.col(c))
    return {
        "balcony": S.tri_or(b("prop_balcony"), x.listed("HasBalconies", "HasTerraces"), x.main_flag("NumBalconies", "NumTerraces")),
        "elevator": S.tri_or(b("prop_elevator"), x.listed("HasLift")),
        "parking": S.tri_or(b("prop_parking"), x.listed("HasParkingOutdoor", "HasParkingIndoor")),
        "garage": S.tri_or(b("prop_garage"), x.listed("HasParkingIndoor")),
        "fireplace": S.tri_or(b("prop_fireplace"), x.listed("HasFireplace")),
        "child_friendly": b("prop_child_friendly"),
        "pets_allowed": S.tri_or(b("animal_allowed"), x.main_flag("PetsAllowed")),
        "temporary": b("maybe_temporary"),
        "new_build": S.tri_or(b("is_new_building"), x.main_flag("IsNewBuilding")),
        "wheelchair_accessible": x.main_flag("IsWheelchairAccessible"),
        "private_laundry": x.listed("HasWashingmachine", "HasDryer"),
        "minergie_certified": x.main_flag("IsMinergieCertified"),
    }


def prepare(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed listings from raw rows: cleaned, with fallbacks from the JSON columns, derived price, rooms and features. Columns keep of raw go along as they are."""
    place = F.from_json(S.clean_text(F.col("location_address")), "City string, PostalCode string, canton string, Street string, StreetNumber string")
    clean = lambda c: S.clean_text(F.col(c))
    at = lambda k: S.clean_text(place[k])
    flags = feature_flags()
    images = S.image_urls(S.clean_text(F.col("images")))
    street = F.coalesce(clean("object_street"), F.when(at("StreetNumber").isNotNull(), F.concat(at("Street"), F.lit(" "), at("StreetNumber"))), at("Street"))
    text = F.coalesce(clean("object_description"), clean("remarks"))
    ints = ("distance_public_transport", "distance_shop", "distance_kindergarten", "distance_school_1", "distance_school_2")
    return raw.withColumns({f"_f_{k}": v for k, v in flags.items()}).select(
        S.strip(F.coalesce("id", F.lit(""))).alias("listing_id"), clean("platform_id").alias("platform_id"), clean("scrape_source").alias("scrape_source"), F.coalesce(clean("title"), F.lit("Untitled listing")).alias("title"), S.strip_markup(text).alias("description"),
        street.alias("street"), F.coalesce(clean("object_city"), at("City")).alias("city"), F.coalesce(clean("object_zip"), at("PostalCode")).alias("postal_code"), F.upper(F.coalesce(clean("object_state"), at("canton"))).alias("canton"),
        S.derive_price(F.col("rent_gross"), F.col("price"), F.col("rent_net"), F.col("rent_extra")).alias("price"), F.coalesce(F.nullif(S.parse_float(F.col("number_of_rooms")), F.lit(0.0)), S.rooms_in(clean("title"))).alias("rooms"), S.parse_float(F.col("area")).alias("area"),
        S.parse_date(F.col("available_from")).alias("available_from"), S.parse_float(F.col("geo_lat")).alias("latitude"), S.parse_float(F.col("geo_lng")).alias("longitude"), *(S.parse_int(F.col(c)).alias(c) for c in ints), *(F.col(f"_f_{k}").alias(f"feature_{k}") for k in flags),
        F.array_compact(F.array(*(F.when(F.col(f"_f_{k}"), F.lit(k)) for k in flags))).alias("features"), F.upper(clean("offer_type")).alias("offer_type"), clean("object_category").alias("object_category"), clean("object_type").alias("object_type"), clean("platform_url").alias("original_url"),
        images.alias("image_urls"), F.try_element_at(images, F.lit(1)).alias("hero_image_url"), F.col("location_address"), F.col("orig_data"), F.to_json(F.struct(*(F.col(c) for c in raw.columns if c not in keep))).alias("raw"), *keep,
    )


def bootstrap(listings: DataFrame, path: str, cluster: str = "city", row_group_bytes: int = 16 << 20) -> bool:
    """Write the table once, clustered by canton and city, or by `place`, so that what is near lies together; false, and nothing done, if it is there. A repeated id is an error."""
    spark = listings.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    if twice := listings.groupBy("listing_id").count().where("count > 1").take(1):
        raise ValueError(f"listing_id {twice[0].listing_id!r} is not unique")
    order = {"city": ["canton", "city"], "place": [place_code(F.col("latitude"), F.col("longitude"))]}[cluster]
    own = listings.repartitionByRange(*order, "listing_id").sortWithinPartitions(*order)
    own.write.mode("errorifexists").option("parquet.block.size", row_group_bytes).parquet(path)
    return True


def missing_columns(df: DataFrame, required) -> set[str]:
    return set(required) - set(df.columns)


def backfill(listings: DataFrame) -> DataFrame:
    """Rooms from the title where unknown; descriptions without markup."""
    return listings.withColumns({"rooms": F.coalesce("rooms", S.rooms_in(F.col("title"))), "description": S.strip_markup(F.col("description"))})


def backfill_counts(listings: DataFrame) -> DataFrame:
    """What backfill would change."""
    return listings.agg(F.count_if(F.col("rooms").isNull() & S.rooms_in(F.col("title")).isNotNull()).alias("rooms_filled"), F.count_if(F.col("description").isNotNull() & (S.strip_markup(F.col("description")) != F.col("description"))).alias("descriptions_cleaned"))
