"""Filters on candidates that give way rather than leave a query with too few.

They run on a query's capped pool, so a window over query_id is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.scalars import any_of, holds, matches

#: What any match of a pattern holds: long texts without are not searched by it.
PARTS = {
    V.EXCHANGE: ("tausch", "swap"),
    V.COLIVING: ("living",),
    V.WG_ROOM: ("zimmer", "camera", "room", "chambre"),
    V.TEMPORARY_LISTING: ("befristet", "tempor", "fixed", "kurzfristig", "bis"),
    V.SWAP: ("tausch", "swap", "change", "scambio"),
    V.WANTED: ("suche", "cherche", "reprise", "cerco", "wanted", "looking"),
    V.SHORT_TERM: ("befristet", "tempor", "zwischenmiete", "untervermietung", "location", "sublet", "abriss", "demoli", "bis", "jusqu", "fino"),
}


def in_text(text: Column, pattern: str) -> Column:
    return matches(text, pattern, PARTS[pattern])


def text_of(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))


def guarded(df: DataFrame, keep: Column, least: int = 1) -> DataFrame:
    """Rows to keep; all rows of a query in which fewer than least would be left."""
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return flagged.withColumn("_kept", F.count_if("_keep").over(Window.partitionBy("query_id"))).where(F.col("_keep") | (F.col("_kept") < least)).drop("_keep", "_kept")


def wants_temporary(query: Column) -> Column:
    return matches(query, V.WANTS_TEMPORARY)


def wants_shared(query: Column, student: Column | None = None) -> Column:
    asked = any_of(F.lower(F.coalesce(query, F.lit(""))), V.SHARED_WORDS)
    return asked if student is None else asked | F.coalesce(student, F.lit(False))


def wants_short_term(query: Column, availability: Column | None = None) -> Column:
    asked = matches(query, V.SHORT_TERM_QUERY)
    return asked if availability is None else asked | matches(availability, V.SHORT_TERM_QUERY)


def wants_long_term(query: Column, availability: Column | None = None) -> Column:
    return ~wants_short_term(query, availability) & matches(query, V.LONG_TERM_QUERY)


def listing_type_filter(df: DataFrame, query: Column, student: Column | None = None) -> DataFrame:
    """Exchanges and wanted ads go, shared living too unless wanted."""
    text = text_of(F.col("title"), F.col("description"))
    shared = wants_shared(query, student)
    return guarded(df, ~in_text(text, V.EXCHANGE) & ~matches(F.col("title"), V.WANTED_TITLE) & (shared | ~(in_text(text, V.COLIVING) | in_text(text, V.WG_ROOM))))


def tenancy_filter(df: DataFrame, query: Column) -> DataFrame:
    return guarded(df, wants_temporary(query) | ~in_text(text_of(F.col("title"), F.col("description")), V.TEMPORARY_LISTING))


def area_filter(df: DataFrame, min_area: Column) -> DataFrame:
    """At least 97 per cent of the area asked for; no area is none."""
    return guarded(df, F.coalesce(min_area, F.lit(0)).cast("double").eqNullSafe(0.0) | (F.coalesce("area", F.lit(0.0)) >= min_area * V.AREA_SHARE))


def soft_filters(df: DataFrame, query: Column, min_area: Column, student: Column | None = None) -> DataFrame:
    """The three above in turn, each on what the one before has left."""
    return area_filter(tenancy_filter(listing_type_filter(df, query, student), query), min_area)


def drop_reason() -> Column:
    """Why a listing is never shown: swap, wanted, or abroad, in this order; null if it may be."""
    text = text_of(F.col("title"), F.col("description"))
    return F.when(in_text(text, V.SWAP), "swap_listing").when(in_text(text, V.WANTED), "wanted_listing").when(matches(F.col("title"), V.NON_SWISS_TITLE), "non_swiss_title")


def short_term_phrase() -> Column:
    """The words by which a listing is a short let; null if there are none."""
    text = text_of(F.col("title"), F.col("description"))
    found = F.regexp_extract(text, f"(?iuU)({V.SHORT_TERM})", 1)
    return F.when(holds(text, PARTS[V.SHORT_TERM]), F.when(found != "", F.lower(F.trim(found))))


def quality_filter(df: DataFrame, query: Column, availability: Column | None = None, least: int = V.MIN_RESULTS) -> DataFrame:
    """Swaps, wanted ads and listings abroad go; short lets too if the query means to stay, unless that leaves fewer than least."""
    kept = df.where(drop_reason().isNull())
    return guarded(kept, ~wants_long_term(query, availability) | short_term_phrase().isNull(), least)


def drop_counts(df: DataFrame, query: Column, availability: Column | None = None, least: int = V.MIN_RESULTS) -> DataFrame:
    """(query_id, reason, n): how many rows went and why; restored and kept short lets are counted under a name of their own."""
    phrase = short_term_phrase()
    flagged = df.select("query_id", drop_reason().alias("why"), phrase.alias("phrase"), wants_long_term(query, availability).alias("long"), wants_short_term(query, availability).alias("short"))
    left = F.count_if(F.col("why").isNull() & F.col("phrase").isNull()).over(Window.partitionBy("query_id"))
    short = F.col("why").isNull() & F.col("phrase").isNotNull()
    reason = F.coalesce("why", F.when(short & F.col("short"), "_short_term_kept_by_intent").when(short & F.col("long") & (F.col("left") < least), "_short_term_restored").when(short & F.col("long"), F.concat(F.lit("temporary:"), F.col("phrase"))))
    return flagged.withColumn("left", left).select("query_id", reason.alias("reason")).where("reason is not null").groupBy("query_id", "reason").agg(F.count("*").alias("n"))


def locality_filter(df: DataFrame, hints: Column, least: int = V.MIN_RESULTS) -> DataFrame:
    """Rows whose texts hold one of the hints if at least so many do; else all."""
    wanted = F.filter(F.transform(hints, lambda h: F.trim(F.lower(h))), lambda h: h != "")
    hay = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "street", "postal_code"))))
    return guarded(df, F.coalesce(F.size(wanted), F.lit(0)).isin(0, -1) | F.exists(wanted, lambda h: F.contains(hay, h)), least)
