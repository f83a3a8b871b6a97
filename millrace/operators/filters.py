"""Hard filters of a batch of intents over listings, with controlled relaxation, in one scan.

Listings carry the columns of plans.schema.LISTING, intents those of
plans.schema.INTENT. An intent is a row: its null fields ask for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.geo import boxes, distance_km, in_box

#: Intents of one batch at most: the side that is broadcast.
MOST_INTENTS = 2_000
#: Relaxable fields in the order in which they give way; a field's number is its level.
STEPS = ("max_area", "min_area", "features", "max_price", "min_price", "max_rooms", "min_rooms", "max_floor", "min_floor")

q = F.col  # names of intents are prefixed q_, so that nothing clashes


def normalise_list(c: Column) -> Column:
    """Trimmed, empties dropped; nothing left asks for nothing."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def city_matches(city: Column, wanted: Column) -> Column:
    """A wanted city, or one followed by a blank and anything (`Carouge GE`); no wildcards, Unicode case."""
    low = F.lower(city)
    return F.coalesce(F.exists(wanted, lambda c: (low == F.lower(c)) | F.startswith(low, F.concat(F.lower(c), F.lit(" ")))), F.lit(False))


def residential(category: Column) -> Column:
    return category.isNull() | ~category.isin(*V.NON_RESIDENTIAL)


def exchange_title(title: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w)) for w in V.EXCHANGE_TITLES))


def sublet_title(title: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w)) for w in V.SUBLET_TITLES))


def has_features(wanted: Column) -> Column:
    """All wanted features that we know are set; others ask for nothing."""
    return reduce(lambda a, b: a & b, (~F.array_contains(wanted, f) | (F.coalesce(F.col(f"feature_{f}").cast("int"), F.lit(0)) == 1) for f in V.FEATURES))


def fixed_filter() -> Column:
    """What is never relaxed: place, offer, category, and kinds of title. A null canton, offer or category passes, a null city, postal code or coordinate does not."""
    city, postal, category = (normalise_list(q(f"q_{c}")) for c in ("city", "postal_code", "object_category"))
    lat, lng, radius = q("q_latitude"), q("q_longitude"), q("q_radius_km")
    near = in_box(F.col("latitude"), F.col("longitude"), lat, lng, radius) & (distance_km(lat, lng, F.col("latitude"), F.col("longitude")) <= radius)
    unless = lambda asked, test: ~asked | F.coalesce(test, F.lit(False))
    return (
        unless(city.isNotNull(), city_matches(F.col("city"), city))
        & unless(postal.isNotNull(), F.array_contains(postal, F.col("postal_code")))
        & (q("q_canton").isNull() | F.col("canton").isNull() | (F.upper("canton") == F.upper(q("q_canton"))))
        & (q("q_offer_type").isNull() | F.col("offer_type").isNull() | (F.upper("offer_type") == F.upper(q("q_offer_type"))))
        & F.when(category.isNotNull(), F.col("object_category").isNull() | F.array_contains(category, F.col("object_category"))).otherwise(residential(F.col("object_category")))
        & (F.coalesce(q("q_include_exchange"), F.lit(False)) | ~exchange_title(F.col("title")))
        & (F.coalesce(q("q_include_sublet"), F.lit(False)) | ~sublet_title(F.col("title")))
        & unless(lat.isNotNull() & lng.isNotNull() & radius.isNotNull(), near)
    )


def _bound(step: int, value: str, asked: str, upper: bool, relaxed=None) -> Column:
    """Level at which a row passes one bound: 0 as asked, step relaxed (at 0 or, without relaxed, dropped), null never."""
    v, a = F.col(value), q(f"q_{asked}")
    holds = (lambda b: v <= b) if upper else (lambda b: v >= b)
    after = F.when(a == 0, True).otherwise(holds(relaxed(a))) if relaxed else F.lit(True)
    return F.when(a.isNull() | F.coalesce(holds(a), F.lit(False)), 0).when(F.coalesce(after, F.lit(False)), step)


def relaxation_level() -> Column:
    """The number of the last step that a row needs to pass, 0 for none, null if no step lets it pass.

    Steps are cumulative and only widen, so the largest over the bounds decides.
    Prices widen by a fifth, truncated, rooms by a half; a bound of 0 widens to none. Null values fail a bound until it is dropped.
    """
    bounds = [
        _bound(1, "area", "max_area", True),
        _bound(2, "area", "min_area", False),
        F.when(q("q_features").isNull() | has_features(normalise_list(q("q_features"))) | normalise_list(q("q_features")).isNull(), 0).otherwise(3),
        _bound(4, "price", "max_price", True, lambda a: (a * F.lit(1.2).cast("double")).cast("int")),
        _bound(5, "price", "min_price", False, lambda a: (a * F.lit(0.8).cast("double")).cast("int")),
        _bound(6, "rooms", "max_rooms", True, lambda a: a + 0.5),
        _bound(7, "rooms", "min_rooms", False, lambda a: F.greatest(F.lit(0.0), a - 0.5)),
    ]
    return F.when(reduce(lambda a, b: a | b, (b.isNull() for b in bounds)), F.lit(None)).otherwise(F.greatest(*bounds)).cast("int")


def named(intents: DataFrame) -> DataFrame:
    """Intents with q_ before every name but query_id."""
    return intents.select("query_id", *(F.col(c).alias(f"q_{c}") for c in intents.columns if c != "query_id"))


def matched(listings: DataFrame, intents: DataFrame) -> DataFrame:
    """Listings beside each intent that they can be made to pass, with level.

    One pass over the listings; the intents, a request's batch of at most
    MOST_INTENTS, ride along as a broadcast. A larger batch is refused. Where every intent asks
    for a radius, ranges around them all go to the scan, which drops the row groups of a table clustered by place.
    """
    asked = intents.select("latitude", "longitude", "radius_km").take(MOST_INTENTS + 1)
    if len(asked) > MOST_INTENTS:
        raise ValueError(f"a batch has at most {MOST_INTENTS} intents")
    if asked and all(x is not None for r in asked for x in r):
        listings = listings.where(boxes([tuple(r) for r in asked], F.col("latitude"), F.col("longitude")))
    return listings.join(F.broadcast(named(intents)), fixed_filter()).withColumn("level", relaxation_level()).where("level is not null")


def active_steps() -> Column:
    return F.array_compact(F.array(*(F.when(q(f"q_{s}").isNotNull(), F.lit(i)) for i, s in enumerate(STEPS, 1))))


def choose_level(found: DataFrame, intents: DataFrame, *, on_total: bool = False) -> DataFrame:
    """(query_id, chosen, relaxed): the first active step whose page has MIN_RESULTS rows, else the last; relaxed names the steps up to there.

    A page is limit rows from offset on; on_total tests all rows instead.
    """
    counts = found.groupBy("query_id", "level").agg(F.count("*").alias("n"))
    total = counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by_level"))  # ten levels at most
    own = named(intents).join(total, "query_id", "left").withColumn("steps", F.concat(F.array(F.lit(0)), active_steps()))
    upto = lambda k: F.aggregate(F.map_entries(F.coalesce("by_level", F.create_map().cast("map<int,bigint>"))), F.lit(0).cast("bigint"), lambda s, e: s + F.when(e["key"] <= k, e["value"]).otherwise(0))
    chosen, relaxed = _choice(upto, on_total)
    return own.select("query_id", chosen.alias("chosen"), relaxed.alias("relaxed"))


def _choice(upto, on_total: bool) -> tuple[Column, Column]:
    """(chosen, relaxed) over a column steps; upto(k) is how many rows pass by step k."""
    page = upto if on_total else lambda k: F.least(F.coalesce(q("q_limit"), F.lit(20)).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), upto(k) - F.coalesce(q("q_offset"), F.lit(0))))
    enough = F.filter("steps", lambda k: page(k) >= V.MIN_RESULTS)
    chosen = F.coalesce(F.try_element_at(enough, F.lit(1)), F.element_at("steps", -1))
    names = F.array(*map(F.lit, STEPS))
    return chosen, F.transform(F.filter("steps", lambda k: (k > 0) & (k <= chosen)), lambda k: F.element_at(names, k))


def _order() -> list[Column]:
    return [F.col("sort_value").asc_nulls_last(), F.col("listing_id")]


def sort_value() -> Column:
    """What a query sorts by before the id: distance if it has a circle, else its sort_by; nulls last either way."""
    circle = q("q_latitude").isNotNull() & q("q_longitude").isNotNull() & q("q_radius_km").isNotNull()
    by = F.when(q("q_sort_by") == "price_asc", F.col("price")).when(q("q_sort_by") == "price_desc", -F.col("price")).when(q("q_sort_by") == "rooms_asc", F.col("rooms")).when(q("q_sort_by") == "rooms_desc", -F.col("rooms"))
    return F.when(circle, distance_km(q("q_latitude"), q("q_longitude"), F.col("latitude"), F.col("longitude"))).otherwise(by.cast("double"))


def numbered(found: DataFrame, most: int | None = None) -> DataFrame:
    """found with cand_ord, its place from 1 on within the query; most keeps the first so many."""
    w = Window.partitionBy("query_id").orderBy(*_order())
    if "sort_value" not in found.columns:
        found = found.withColumn("sort_value", sort_value())
    out = found.withColumn("cand_ord", F.row_number().over(w))
    return out.where(F.col("cand_ord") <= most) if most else out


def hard_filter(listings: DataFrame, intents: DataFrame, *, cap: int | None = None, page: bool = True, on_total: bool = False) -> DataFrame:
    """Candidates of each query: listings that pass at the chosen level, numbered by its order, its page only unless page is false, cap at most; with chosen and relaxed.

    One scan. The batch's last page end, or cap, bounds what a query can show and
    what the choice of a level looks at, so each level's first rows up to that
    bound, a literal that partial top-k lists use before any exchange, decide both.
    """
    found = matched(listings, intents).withColumn("sort_value", sort_value())
    if not page and not cap:  # all rows are asked for
        return numbered(found.join(F.broadcast(choose_level(found, intents, on_total=on_total)), "query_id").where("level <= chosen"))  # one row for each intent
    end = intents.agg(F.max(F.coalesce("limit", F.lit(20)) + F.coalesce("offset", F.lit(0)))).first()[0] or 0
    by_level = Window.partitionBy("query_id", "level").orderBy(*_order())
    few = found.withColumn("_nth", F.row_number().over(by_level)).where(F.col("_nth") <= max(cap or 0, end, V.MIN_RESULTS)).drop("_nth")
    counts = F.array(*(F.count_if(F.col("level") == k).over(Window.partitionBy("query_id")) for k in range(len(STEPS) + 1)))
    few = few.withColumns({"_counts": counts, "steps": F.concat(F.array(F.lit(0)), active_steps())})
    upto = lambda k: F.aggregate(F.slice("_counts", 1, k + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
    chosen, relaxed = _choice(upto, on_total)
    out = numbered(few.withColumns({"chosen": chosen, "relaxed": relaxed}).where("level <= chosen").drop("_counts", "steps"), min(cap or end, end) if page else cap)
    if page:
        out = out.where((F.col("cand_ord") > F.coalesce(q("q_offset"), F.lit(0))) & (F.col("cand_ord") <= F.coalesce(q("q_offset"), F.lit(0)) + F.coalesce(q("q_limit"), F.lit(20))))
    return out
