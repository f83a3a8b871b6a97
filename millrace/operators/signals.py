"""Relevance signals of candidates: normalisation, price, distance, language."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.geo import decay
from millrace.functions.text import detect_language
from millrace.operators.quality import text_of

def _by(by):
    return by if by is not None else Window.partitionBy("query_id")


def min_max(c: Column, by=None) -> Column:
    """To 0..1 within the query; all 0 if there is no spread; null, that is unscored, stays null."""
    low, high = F.min(c).over(_by(by)), F.max(c).over(_by(by))
    return F.when(c.isNotNull(), F.when(high > low, (c - low) / (high - low)).otherwise(0.0))


def max_norm(c: Column, by=None) -> Column:
    """Shares of the query's largest value; unchanged if that is not over 0."""
    high = F.max(c).over(_by(by))
    return F.when(high > 0, c / high).otherwise(c)


def clipped(c: Column) -> Column:
    """Negative relevance is none."""
    return min_max(F.when(c.isNotNull(), F.greatest(F.lit(0.0), c)))


def price_band(price: Column, intent: Column, by=None) -> Column:
    """cheap favours low prices, premium high ones, mid those near the median; without price or intent unscored."""
    p = F.when(price.isNotNull() & intent.isNotNull(), price.cast("double"))
    raw = F.when(intent == "cheap", -p).when(intent == "premium", p).when(intent == "mid", -F.abs(p - F.median(p).over(_by(by))))
    return min_max(raw, by)


def proximity(metres: Column, signal: str, gate: Column) -> Column:
    return min_max(F.when(gate, decay(metres.cast("double"), V.TAU[signal])))


def language_match(title: Column, description: Column, language: Column) -> Column:
    """1 or 0, a half without text, then min-max: all 0 if all candidates agree; unscored for an unknown query language."""
    text = text_of(title, description)
    return min_max(F.when(language != "unknown", F.when(text == "", 0.5).when(detect_language(text) == language, 1.0).otherwise(0.0)))


def transit_metres() -> Column:
    """The enriched distance, else the listing's own."""
    return F.coalesce("geo_transit_m", "distance_public_transport")


def visual_prompt(query: Column, descriptors: Column) -> Column:
    """Descriptors joined; else the query if it has a visual word; else null."""
    words = F.array(*map(F.lit, V.VISUAL_WORDS))
    said = F.trim(F.concat_ws(" ", descriptors))
    return F.when(said != "", said).when(F.exists(words, lambda w: F.contains(F.lower(query), w)), query)
