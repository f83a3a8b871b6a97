"""Weights of the signals from an intent: defaults, gates, hints, overrides, and a sum of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import values as V


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _hint(weights: Column, key: str) -> Column:
    return F.try_element_at(weights, F.lit(key))


def gates(prefix: str = "") -> dict[str, Column]:
    """Whether a query has use for each signal that is not always on. vlm_active says that image scores exist."""
    c = lambda name: F.col(prefix + name)
    return {
        "dense": F.lit(True),
        "bm25": F.lit(True),
        "vlm": _yes(c("vlm_active")),
        "geo_transit": _yes(c("near_public_transport")),
        "geo_school": _yes(c("near_schools")) | _yes(c("family_friendly")),
        "geo_anchor": (F.coalesce(F.size(c("anchors")), F.lit(0)) > 0) | _yes(_hint(c("weights"), "geo_anchor") > 0),
        "price_band": c("price_intent").isNotNull(),
        "lang_match": c("language") != "unknown",
    }


def raw_weights(prefix: str = "", overrides: Column | None = None) -> dict[str, Column]:
    """Weights by signal before they are made to sum to one.

    A hint, the largest of those that mean a signal, replaces its default
    unless its gate is shut. While no image scores exist, visual hints raise
    dense to its default and half of them. Overrides go last.
    """
    hints, open_ = F.col(prefix + "weights"), gates(prefix)
    visual = F.greatest(*(F.coalesce(_hint(hints, k), F.lit(0.0)) for k in V.WEIGHT_KEYS["vlm"]))
    out: dict[str, Column] = {}
    for name, default in V.SIGNALS.items():
        # greatest() would make 0 of a hint that is not there.
        said = [F.when(_hint(hints, k).isNotNull(), F.greatest(F.lit(0.0), _hint(hints, k))) for k in V.WEIGHT_KEYS[name]]
        hint = F.lit(None).cast("double") if not said else said[0] if len(said) == 1 else F.greatest(*said)
        if name == "dense":
            raised = F.when(~open_["vlm"] & (visual > 0), F.greatest(F.coalesce(hint, F.lit(0.0)), F.lit(default) + 0.5 * visual))
            hint = F.coalesce(raised, hint)
        w = F.when(open_[name], F.coalesce(hint, F.lit(default))).otherwise(0.0)
        if overrides is not None:
            w = F.coalesce(F.when(_hint(overrides, name).isNotNull(), F.greatest(F.lit(0.0), _hint(overrides, name))), w)
        out[name] = w
    return out


def with_weights(intents: DataFrame, overrides: Column | None = None) -> DataFrame:
    """intents with w_ and a signal's name for each weight; they sum to one. If all are 0, those always on have their defaults."""
    raw = intents.withColumns({f"_w_{k}": c for k, c in raw_weights("", overrides).items()})
    raw = raw.withColumn("_w", reduce(lambda a, b: a + b, (F.col(f"_w_{k}") for k in V.SIGNALS)))
    rest = sum(V.SIGNALS[k] for k in V.ALWAYS_ON)
    return raw.withColumns({f"w_{k}": F.when(F.col("_w") > 0, F.col(f"_w_{k}") / F.col("_w")).otherwise(F.lit(V.SIGNALS[k] / rest if k in V.ALWAYS_ON else 0.0)) for k in V.SIGNALS}).drop("_w", *(f"_w_{k}" for k in V.SIGNALS))


def parse_overrides(text: Column) -> Column:
    """Weights by signal of a text `dense=0.5,bm25=0.2`; what is no number is left out."""
    return F.map_filter(F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: F.trim(v).try_cast("double")), lambda k, v: v.isNotNull())


def derived_weights(prefix: str = "") -> Column:
    """A weight map from soft flags alone, for intents that came without."""
    c = lambda name: F.col(prefix + name)
    image = F.when(_yes(c("nice_views")) | _yes(c("balcony_or_terrace")) | _yes(c("spacious")), 0.75).when(F.coalesce(F.size(c("descriptors")), F.lit(0)) > 0, 0.6)
    entries = [
        ("dense_text", F.lit(0.6)),
        ("bm25", F.lit(0.4)),
        ("brightness", F.when(_yes(c("bright")), 0.9)),
        ("modernity", F.when(_yes(c("modern")) | _yes(c("new_build")), 0.8)),
        ("clip_image", image),
        ("geo_anchor", F.when(F.coalesce(F.size(c("anchors")), F.lit(0)) > 0, 0.9)),
        ("transit", F.when(_yes(c("near_public_transport")), 0.8)),
        ("price_band", F.when(c("price_intent").isNotNull(), 0.75)),
        ("feature_match", F.when(_yes(c("family_friendly")) | _yes(c("near_schools")), 0.6)),
    ]
    return F.map_filter(F.create_map(*(x for k, v in entries for x in (F.lit(k), v.cast("double")))), lambda k, v: v.isNotNull())


def hints_of(prefix: str = "") -> Column:
    """The intent's own weights, or the derived ones if it has none."""
    own = F.col(prefix + "weights")
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(derived_weights(prefix))
