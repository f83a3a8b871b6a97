"""Nearest points of interest: few by grid cells where those answer and by the whole set where they do not, many by quadtree cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.geo import decay, distance_m
from millrace.operators import knn
from millrace.sources.stores import written

#: Points of interest that are broadcast at most, for rows that the grid leaves open: each of those rows meets them all. More of them meet by quadtree cells.
MOST_BROADCAST = 5_000
#: Points of one request that are broadcast at most.
MOST_POINTS = 10_000


def extract_coordinates(elements: DataFrame) -> DataFrame:
    """(lat, lon, name, kind, poi_type): a node's own coordinates or an area's centre; elements without are dropped."""
    node = F.col("type") == "node"
    kind = F.coalesce(*(F.nullif(F.col(f"tags.{t}"), F.lit("")) for t in ("amenity", "highway", "railway", "shop")))
    out = elements.select(*(["poi_type"] if "poi_type" in elements.columns else []), F.when(node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"), F.when(node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"), F.col("tags.name").alias("name"), kind.alias("kind"))
    return out.where("lat is not null and lon is not null")


def _best(carry: list[str]) -> Column:
    """The least distance with what lies there, the least of that among equals."""
    d = distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    # A number alone aggregates by hash, a struct by sorting.
    return (F.min(F.struct(d.alias("d"), *carry)) if carry else F.struct(F.min(d).alias("d"))).alias("s")


def nearest(points: DataFrame, pois: DataFrame, *, id: str = "listing_id", cell: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, poi_type, metres, exact, and the columns carry of the nearest): for each point and type the distance to the nearest, truncated and as it is.

    Points meet what lies in their own and the eight cells around; what is
    nearer than the edge of those is certain. The rest, far from any, meets the
    types' whole sets, which are broadcast. Above MOST_BROADCAST points of interest, each type has
    a quadtree of its own, and points meet what its leaves hold: see knn.meeting().
    """
    own = points.where("latitude is not null and longitude is not null").select(F.col(id).alias("id"), "latitude", "longitude")
    held = pois.select("poi_type", "lat", "lon", *carry)
    if held.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        found = _by_leaves(own, held, carry)
    else:
        found = _by_grid(own, held, cell, list(carry))
    return found.select(F.col("id").alias(id), "poi_type", F.col("d").cast("int").alias("metres"), F.col("d").alias("exact"), *carry)


def _by_leaves(own: DataFrame, pois: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    own, pois = written(own), written(pois.where("poi_type is not null"))  # read once a type
    each = []
    for (kind,) in pois.select("poi_type").distinct().collect():  # a handful of types
        met = knn.meeting(own, pois.where(F.col("poi_type") == F.lit(kind)), 1, id="id", carry=carry)
        best = F.min(F.struct("d", *carry)) if carry else F.struct(F.min("d").alias("d"))
        each.append(met.groupBy("id").agg(best.alias("s")).select("id", F.lit(kind).alias("poi_type"), "s.*"))
    return reduce(DataFrame.unionByName, each)


def _by_grid(own: DataFrame, pois: DataFrame, cell: float, carry: list[str]) -> DataFrame:
    found = _within(own, pois, cell, carry).select("id", "poi_type", "s.*")
    types = pois.select("poi_type").distinct()
    asked = own.join(F.broadcast(types), how="cross")  # a handful of types
    joined = asked.join(found, ["id", "poi_type"], "left")
    # The narrowest gap between a point and the edge of its nine cells, less a hundredth for the sphere.
    sure = F.lit(0.99 * cell * 111_000.0) * F.cos(F.radians(F.abs("latitude") + cell))
    done = joined.where(F.col("d") <= sure).select("id", "poi_type", "d", *carry)
    rest = joined.where(F.col("d").isNull() | (F.col("d") > sure)).select("id", "poi_type", "latitude", "longitude")
    far = rest.join(F.broadcast(pois), "poi_type").groupBy("id", "poi_type").agg(_best(carry)).select("id", "poi_type", "s.*")
    return done.unionByName(far)


def _within(own: DataFrame, pois: DataFrame, cell: float, carry: list[str]) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((at("latitude") + i).alias("x"), (at("longitude") + j).alias("y"))))))
    asked = own.select("*", around.alias("c")).select("id", "latitude", "longitude", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    held = pois.select("poi_type", "lat", "lon", *carry, at("lat").alias("x"), at("lon").alias("y"))
    return asked.join(held, ["x", "y"]).groupBy("id", "poi_type").agg(_best(carry))


def k_nearest(points: DataFrame, pois: DataFrame, k: int = 5, radius_m: float = 2000.0, *, id: str = "point_id") -> DataFrame:
    """(id, rank, distance_m, lat, lon, name, kind): the k nearest whose truncated distance is within the radius.

    Points of one request, MOST_POINTS at most, are broadcast, and only points of interest within a box around one are measured. More of them meet by quadtree cells.
    """
    if len(points.select(id).take(MOST_POINTS + 1)) > MOST_POINTS:
        return knn.k_nearest_join(points, pois, k, radius_m=radius_m, id=id, carry=("name", "kind")).select(id, "rank", F.col("metres").alias("distance_m"), "lat", "lon", "name", "kind")
    margin = (radius_m + 1.0) / 111_000.0
    near = (F.abs(F.col("lat") - F.col("latitude")) <= margin) & (F.abs(F.col("lon") - F.col("longitude")) <= margin / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs("latitude") + margin))))
    met = pois.join(F.broadcast(points.select(F.col(id), "latitude", "longitude")), near).withColumn("d", distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")))
    w = Window.partitionBy(id).orderBy("d", "lat", "lon", "name")
    return met.withColumn("distance_m", F.col("d").cast("int")).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("distance_m") <= radius_m)).select(id, "rank", "distance_m", "lat", "lon", "name", "kind")


def nearest_anchor(lat: Column, lng: Column) -> Column:
    """(name, metres) of the nearest of the known universities; null without coordinates."""
    sites = F.array(*(F.struct(distance_m(lat, lng, F.lit(a), F.lit(b)).alias("metres"), F.lit(name).alias("name")) for name, (a, b) in V.ANCHORS.items()))
    best = F.array_min(sites)
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(best["name"].alias("name"), best["metres"].alias("metres")))


def reverse_geocode(points: DataFrame, places: DataFrame, *, id: str = "listing_id") -> DataFrame:
    """(id, city, canton) of the nearest place (name, admin1, country, lat, lon); null beyond Switzerland."""
    from millrace.functions.scalars import lookup, place_city

    held = places.select(F.lit("place").alias("poi_type"), "lat", "lon", F.struct("name", "admin1", "country").alias("place"))
    one = nearest(points, held, id=id, carry=("place",))
    home = F.col("place.country") == "CH"
    return one.select(id, F.when(home, place_city(F.col("place.name"))).alias("city"), F.when(home, lookup(V.PLACE_CANTONS, F.col("place.admin1"))).alias("canton"))


GEO_COLUMNS = {"transit": "geo_transit_m", "supermarket": "geo_supermarket_m", "school": "geo_school_m", "university": "geo_university_m"}


def enrich(listings: DataFrame, pois: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Listings with the four distances filled where any is missing, and city and canton together where the city is."""
    missing = listings.where(" or ".join(f"{c} is null" for c in GEO_COLUMNS.values()))
    found = nearest(missing, pois).groupBy("listing_id").pivot("poi_type", list(GEO_COLUMNS)).agg(F.first("metres"))
    out = listings.join(found.select("listing_id", *(F.col(k).alias(f"_{k}") for k in GEO_COLUMNS)), "listing_id", "left")
    out = out.withColumns({c: F.coalesce(f"_{k}", c) for k, c in GEO_COLUMNS.items()}).drop(*(f"_{k}" for k in GEO_COLUMNS))
    if places is not None:
        homes = reverse_geocode(listings.where("city is null and latitude is not null and longitude is not null"), places).select("listing_id", F.col("city").alias("_city"), F.col("canton").alias("_canton"))
        fill = F.col("city").isNull() & F.col("_city").isNotNull()
        out = out.join(homes, "listing_id", "left").withColumns({"canton": F.when(fill, F.col("_canton")).otherwise(F.col("canton")), "city": F.coalesce("city", "_city")}).drop("_city", "_canton")
    return out.select(*listings.columns)


def proximity_raw(metres: Column, tau: float) -> Column:
    return decay(metres.cast("double"), tau)
