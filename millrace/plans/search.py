"""The whole search as one plan: intents in, explained ranked results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import bm25, dense, filters, quality, ranking, signals, vectors, weights
from millrace.sources.stores import written


def filter_search(listings: DataFrame, intents: DataFrame) -> DataFrame:
    """The structured path: hard filters with relaxation, listing type, tenancy and area, then a constant rank."""
    found = filters.hard_filter(listings, intents)
    none = F.lit("")
    # The structured path asks with an empty query: shared and temporary lets go, the area rule is idle.
    return ranking.constant_rank(quality.soft_filters(found, none, F.lit(None).cast("int")))


def candidates(listings: DataFrame, intents: DataFrame, *, cap: int = V.CANDIDATE_CAP) -> DataFrame:
    """The pool to be scored: at most cap rows a query after relaxation, less what quality and locality take away."""
    pool = filters.hard_filter(listings, intents.withColumns({"limit": F.lit(cap), "offset": F.lit(0)}), cap=cap, page=False)
    kept = quality.quality_filter(pool, F.col("q_raw_query"), F.col("q_availability_hint"))
    return quality.locality_filter(kept, F.col("q_locality_hints"))


def trace(listings: DataFrame, intents: DataFrame, *, cap: int = V.CANDIDATE_CAP) -> DataFrame:
    """(query_id, stage, rows, state): what the stages before scoring leave of each query."""
    asked = intents.withColumns({"limit": F.lit(cap), "offset": F.lit(0)})
    found = written(filters.hard_filter(listings, asked, cap=cap, page=False))
    good = quality.quality_filter(found, F.col("q_raw_query"), F.col("q_availability_hint"))
    return ranking.stage_trace({"hard_filter": found, "quality": good, "locality": quality.locality_filter(good, F.col("q_locality_hints"))}, intents)


def feedback(intents: DataFrame, clicks: DataFrame, store: DataFrame) -> DataFrame:
    """Intents, with session_id, whose query vector moved a fifth towards the mean of what the session clicked (session_id, listing_id)."""
    mean = vectors.mean_vector(clicks.join(store.select("listing_id", "vector"), "listing_id"), "session_id")
    return intents.join(mean, "session_id", "left").withColumn("query_vector", vectors.blend(F.col("query_vector"), F.col("mean"), V.FEEDBACK_SHARE)).drop("mean")


def _columns() -> tuple[dict[str, Column], dict[str, Column]]:
    return {k: F.col(f"s_{k}") for k in V.SIGNALS}, {k: F.col(f"q_w_{k}") for k in V.SIGNALS}


def score(pool: DataFrame, near: DataFrame | None, lexical: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """pool, whose intents had their weights, with a column for each signal (s_) and the score. near, lexical and images carry (query_id, listing_id, value)."""
    out = pool
    for name, df, value in (("dense", near, "cosine"), ("bm25", lexical, "bm25"), ("vlm", images, "vlm")):
        if df is None:
            out = out.withColumn(f"r_{name}", F.lit(None).cast("double"))
        else:
            out = out.join(df.select("query_id", "listing_id", F.col(value).alias(f"r_{name}")), ["query_id", "listing_id"], "left")
    q = lambda c: F.col(f"q_{c}")
    raw = {
        "dense": signals.clipped(F.col("r_dense")),
        "bm25": signals.clipped(F.col("r_bm25")),
        "vlm": signals.min_max(F.col("r_vlm")),
        "geo_transit": signals.proximity(signals.transit_metres(), "geo_transit", weights.gates("q_")["geo_transit"]),
        "geo_school": signals.proximity(F.col("geo_school_m"), "geo_school", weights.gates("q_")["geo_school"]),
        "geo_anchor": signals.proximity(F.col("geo_university_m"), "geo_anchor", weights.gates("q_")["geo_anchor"]),
        "price_band": signals.price_band(F.col("price"), q("price_intent")),
        "lang_match": signals.language_match(F.col("title"), F.col("description"), q("language")),
    }
    out = out.withColumns({f"s_{k}": c for k, c in raw.items()})
    s, w = _columns()
    return out.withColumn("score", ranking.fused(s, w) * ranking.room_factor(F.col("object_category"), q("raw_query")))


def explain(ranked: DataFrame) -> DataFrame:
    """rank, listing, score to six decimals, reason, the signals over 0, weights, and the three largest contributions."""
    s, w = _columns()
    parts = ranking.contributions(s, w)
    return ranked.select(
        "query_id", "rank", "listing_id", F.round("score", 6).alias("score"), ranking.reason(parts).alias("reason"),
        F.map_filter(ranking.signal_map(s, 4), lambda k, v: v > 0).alias("signals"), ranking.signal_map(w, 6).alias("weights"), ranking.top_signals(parts).alias("top_signals"),
        "title", "city", "canton", "price", "rooms", "area", "relaxed",
    )


def search(listings: DataFrame, intents: DataFrame, index: bm25.Bm25Index, store: DataFrame | None = None, images: DataFrame | None = None, *, top: int | None = None, overrides: Column | None = None, model: str | None = None) -> DataFrame:
    """Explained results of each intent: its limit of them, less its offset.

    index covers listings by listing_id; store holds their text vectors and
    images (path, vector) their pictures' vectors; queries without a
    query_vector, and listings without a vector, go without that signal.
    """
    intents = weights.with_weights(intents, overrides).withColumns({"page_limit": F.coalesce("limit", F.lit(20)), "page_offset": F.coalesce("offset", F.lit(0))})
    # A few hundred rows a query that take a scan of the listings to find, and are met four times below. They are found while the plan is built.
    pool = written(candidates(listings, intents))
    ids = pool.select("query_id", "listing_id")
    lexical = bm25.score(index, intents, ids.withColumnRenamed("listing_id", "doc_id")).withColumnRenamed("doc_id", "listing_id")
    asked = intents.where("query_vector is not null")
    own = store if store is None or model is None else store.where(F.col("model_id") == model)
    near = dense.of_candidates(own, asked, ids) if own is not None else None
    pictures = vectors.score_images(images, asked, listings, ids) if images is not None else None
    # A listing that no term of the query meets has the score 0, not none.
    lexical = ids.join(lexical, ["query_id", "listing_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    scored = score(pool, near, lexical, pictures)
    limit = F.lit(top) if top else F.col("q_page_limit")
    ranked = ranking.top_k(scored, limit)
    return explain(ranking.result_page(ranked, limit, F.col("q_page_offset")))
