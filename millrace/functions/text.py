"""Tokens and languages of listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import values as V


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("(?U)" + V.TOKEN), F.lit(0))


def tokens(c: Column, stem=None, language: Column | None = None) -> Column:
    """Lower-cased words of two letters up, function words dropped.

    stem, such as stems.by_language, maps the array and the language, by default that of the text, to the stems.
    """
    kept = F.filter(words(c), lambda t: (F.length(t) > 1) & ~t.isin(*V.STOPWORDS))
    return F.coalesce(stem(kept, detect_language(c) if language is None else language) if stem else kept, F.array().cast("array<string>"))


def detect_language(c: Column) -> Column:
    """de, fr, it or en: three points for each known word, one for each known letter; the first of equals, de without any."""
    low = F.lower(F.coalesce(c, F.lit("")))
    own = F.array_distinct(F.regexp_extract_all(low, F.lit("(?U)" + V.TOKEN), F.lit(0)))
    points = {k: 3 * F.size(F.array_intersect(own, F.array(*map(F.lit, w)))) + (F.length(low) - F.length(F.translate(low, V.LANGUAGE_CHARS[k], "")) if V.LANGUAGE_CHARS[k] else F.lit(0)) for k, w in V.LANGUAGE_WORDS.items()}
    ranked = F.array(*(F.struct((-p).alias("points"), F.lit(i).alias("at"), F.lit(k).alias("lang")) for i, (k, p) in enumerate(points.items())))
    best = F.array_min(ranked)
    return F.when(best["points"] < 0, best["lang"]).otherwise("de")
