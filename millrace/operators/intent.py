"""Intents from the words of a query, by rule, and the upkeep of intents from elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.scalars import any_of, canonical_city, strip
from millrace.operators.weights import hints_of


def _group(c: Column, pattern: str) -> Column:
    """The first match's group, null without one."""
    return F.nullif(F.regexp_extract(c, "(?iuU)" + pattern, 1), F.lit(""))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def bedrooms(query: Column) -> Column:
    return _number(_group(query, V.EN_BEDROOMS))


def shifted_rooms(query: Column, min_rooms: Column, max_rooms: Column, spare: float = 1.5) -> tuple[Column, Column]:
    """(min, max) after English N bedrooms became N + 1 rooms, where the bounds named no others."""
    n = bedrooms(query)
    same = lambda c: F.abs(c - n) < 0.01
    due = n.isNotNull() & (min_rooms.isNull() | same(min_rooms))
    return F.when(due, n + 1.0).otherwise(min_rooms), F.when(due & F.coalesce(same(max_rooms), F.lit(False)), n + spare).otherwise(max_rooms)


def hard_features(query: Column) -> Column:
    """Features named without a softener in the 20 characters before the first mention of one of their words; sorted, null without any."""
    q = F.lower(query)

    def named(words) -> Column:
        def plain(w: str) -> Column:
            at = F.instr(q, w)
            before = F.substring(q, F.greatest(F.lit(1), at - 20), F.least(F.lit(20), at - 1))
            return (at > 0) & ~any_of(before, V.SOFTENERS)

        return reduce(lambda a, b: a | b, map(plain, words))

    found = F.array_sort(F.array_compact(F.array(*(F.when(named(words), F.lit(f)) for f, words in V.FEATURE_KEYWORDS.items()))))
    return F.when(F.size(found) > 0, found)


def anchors(query: Column) -> Column:
    """What follows words of nearness, trimmed of blanks, commas and points."""
    return F.transform(F.regexp_extract_all(query, F.lit("(?iuU)" + V.NEAR), F.lit(1)), lambda a: F.regexp_replace(a, r"^[ ,.]+|[ ,.]+$", ""))


def understand(queries: DataFrame) -> DataFrame:
    """queries (query_id, raw_query) with the fields of an intent; an empty query asks for nothing."""
    q, raw = F.lower("raw_query"), F.col("raw_query")
    city = canton = F.lit(None).cast("string")
    for name, known in reversed(V.CITY_HINTS.items()):
        here = F.contains(q, F.lit(name))
        city = F.when(here, F.lit(known)).otherwise(city)
        canton = F.when(here, F.lit(V.CITY_CANTONS.get(name))).otherwise(canton)
    min_rooms = _number(_group(raw, V.ROOMS_WANTED))
    min_rooms, max_rooms = shifted_rooms(raw, min_rooms, F.lit(None).cast("double"))
    flags = {f: any_of(q, words) for f, words in V.SOFT_KEYWORDS.items()}
    out = queries.select(
        "*",
        F.lit("unknown").alias("language"),
        F.when(city.isNotNull(), F.array(city)).alias("city"),
        canton.alias("canton"),
        _group(raw, V.PRICE_LIMIT).cast("int").alias("max_price"),
        min_rooms.alias("min_rooms"),
        max_rooms.alias("max_rooms"),
        _group(raw, V.MIN_AREA).cast("int").alias("min_area"),
        _group(raw, V.MAX_AREA).cast("int").alias("max_area"),
        hard_features(raw).alias("features"),
        *(F.when(c, True).alias(f"soft_{f}" if f in ("parking",) else f) for f, c in flags.items()),
        F.array_compact(F.array(*(F.when(c, F.lit(f.replace("_", " "))) for f, c in flags.items()))).alias("descriptors"),
        reduce(lambda rest, kind: F.when(any_of(q, V.PRICE_INTENTS[kind]), kind).otherwise(rest), reversed(V.PRICE_INTENTS), F.lit(None).cast("string")).alias("price_intent"),
        anchors(raw).alias("anchors"),
    )
    entries = [("bm25", F.lit(0.4)), ("dense_text", F.lit(0.5)), ("feature_match", F.lit(0.6)), ("geo_anchor", F.when(F.size("anchors") > 0, 0.8)), ("brightness", F.when(F.col("bright"), 0.7)), ("modernity", F.when(F.col("modern"), 0.6)), ("transit", F.when(F.col("near_public_transport"), 0.6)), ("price_band", F.when(F.col("price_intent").isNotNull(), 0.6))]
    weights = F.map_filter(F.create_map(*(x for k, v in entries for x in (F.lit(k), v.cast("double")))), lambda k, v: v.isNotNull())
    return out.withColumn("weights", weights)


def assemble(parsed: DataFrame) -> DataFrame:
    """Intents from elsewhere set right: cities canonical and once each, a district's postal codes if one city and no codes are asked for, bedrooms shifted for English, weights derived from the soft flags where none came."""
    table = F.create_map(*(x for k, (_, codes) in V.DISTRICTS.items() for x in (F.lit(k), F.array(*map(F.lit, codes)))))
    cities = F.array_distinct(F.transform(F.filter("city", lambda c: F.trim(c) != ""), canonical_city))
    codes = F.array_distinct(F.flatten(F.array_compact(F.transform("city", lambda c: F.try_element_at(table, F.lower(strip(c)))))))
    none = F.coalesce(F.size("postal_code"), F.lit(0)).isin(0, -1)
    low, high = shifted_rooms(F.col("raw_query"), F.col("min_rooms"), F.col("max_rooms"))
    english = F.col("language") == "en"
    own = {"weights": hints_of()} if "weights" in parsed.columns else {}
    return parsed.withColumns(
        own
        | {
            "postal_code": F.when((F.size(cities) == 1) & none & (F.size(codes) > 0), codes).otherwise(F.col("postal_code")),
            "city": F.when(F.size(cities) > 0, cities),
            "min_rooms": F.when(english, low).otherwise(F.col("min_rooms")),
            "max_rooms": F.when(english, high).otherwise(F.col("max_rooms")),
        }
    )


def reconcile(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first extractor's intents with fields it left unset, or empty, from the second's; bedrooms shifted for English after."""
    fields = ("city", "canton", "postal_code", "offer_type", "object_category", "features", "min_price", "max_price", "min_rooms", "max_rooms", "min_area", "max_area")
    own = [f for f in fields if f in first.columns and f in second.columns]
    kinds = dict(first.dtypes)
    set_ = lambda c, f: F.when(F.size(c) > 0, c) if kinds[f].startswith("array") else F.nullif(c, F.lit("")) if kinds[f] == "string" else c
    joined = first.join(second.select("query_id", *(F.col(f).alias(f"_{f}") for f in own)), "query_id", "left")
    merged = joined.withColumns({f: F.coalesce(set_(F.col(f), f), set_(F.col(f"_{f}"), f)) for f in own}).select(*first.columns)
    low, high = shifted_rooms(F.col("raw_query"), F.col("min_rooms"), F.col("max_rooms"))
    english = F.col("language") == "en"
    return merged.withColumns({"min_rooms": F.when(english, low).otherwise(F.col("min_rooms")), "max_rooms": F.when(english, high).otherwise(F.col("max_rooms"))})
