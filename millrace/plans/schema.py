"""Tables of the engine as schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from millrace.functions import values as V

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "map<string,double>": T.MapType(T.StringType(), T.DoubleType())}


def _schema(fields: str) -> T.StructType:
    """Fields by name and kind; unlike a DDL parser's it needs no session."""
    kind = lambda k: T.ArrayType(_KINDS[k[6:-1]]) if k.startswith("array<") else _KINDS[k]
    return T.StructType([T.StructField(name, kind(k)) for name, k in (x.split() for x in fields.split(", "))])


_FLAGS = ", ".join(f"feature_{f} int" for f in V.FEATURES)

LISTING = _schema(
    "listing_id string, platform_id string, scrape_source string, title string, description string, street string, city string, postal_code string, canton string, price int, rooms double, area double, available_from date, latitude double, longitude double, "
    "distance_public_transport int, distance_shop int, distance_kindergarten int, distance_school_1 int, distance_school_2 int, " + _FLAGS + ", features array<string>, offer_type string, object_category string, object_type string, original_url string, image_urls array<string>, hero_image_url string, "
    "location_address string, orig_data string, raw string, geo_transit_m int, geo_supermarket_m int, geo_school_m int, geo_university_m int"
)
#: What a search may ask for: hard bounds, then soft preferences, then hints.
INTENT = _schema(
    "query_id bigint, raw_query string, language string, city array<string>, postal_code array<string>, canton string, min_price int, max_price int, min_rooms double, max_rooms double, min_area int, max_area int, min_floor int, max_floor int, offer_type string, object_category array<string>, features array<string>, "
    "latitude double, longitude double, radius_km double, include_exchange boolean, include_sublet boolean, sort_by string, limit int, offset int, "
    "bright boolean, modern boolean, quiet boolean, family_friendly boolean, pet_friendly boolean, student_friendly boolean, near_public_transport boolean, near_schools boolean, nice_views boolean, balcony_or_terrace boolean, soft_parking boolean, new_build boolean, furnished boolean, spacious boolean, "
    "descriptors array<string>, anchors array<string>, price_intent string, availability_hint string, locality_hints array<string>, weights map<string,double>, vlm_active boolean, query_vector array<double>"
)
EMBEDDING = _schema("listing_id string, model_id string, dim int, vector array<float>, created_at timestamp")
EVENT = _schema("id string, session_id string, event_type string, listing_id string, ts bigint, dwell_ms bigint")
POI = _schema("poi_type string, lat double, lon double, name string, kind string")
JUDGEMENT = _schema("query_id bigint, rank int, listing_id string, score int, ok boolean")


def intents(spark, rows: list[dict]):
    """Intents from dicts; what a dict leaves out is null, limit 20 and offset 0. Bounds of a request are checked."""
    full = []
    for r in rows:
        if extra := set(r) - set(INTENT.names):
            raise ValueError(f"no such fields: {sorted(extra)}")
        row = {"limit": 20, "offset": 0, "language": "unknown"} | r
        if not 1 <= row["limit"] <= 500 or row["offset"] < 0:
            raise ValueError("limit is 1 to 500, offset 0 or more")
        if any((row.get(f) or 0) < 0 for f in ("min_price", "max_price", "min_rooms", "max_rooms", "min_area", "max_area")):
            raise ValueError("bounds are 0 or more")
        full.append(tuple(row.get(n) for n in INTENT.names))
    return spark.createDataFrame(full, INTENT)
