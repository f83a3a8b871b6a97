"""The k nearest points of interest for many points: a join by quadtree cells, with neither side broadcast.

Points of interest are counted by the cells of a quadtree that is split where
they are dense, three levels at a time. What tasks share is that directory of
cells and counts, whose size is bounded whatever the data's. Each point walks
down it: cells that surely hold k nearer ones cut off all that lie beyond. The
leaves that remain are where the point and the points of interest meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions import values as V
from millrace.functions.geo import distance_m
from millrace.sources.stores import written

#: The finest cells' level, of some metres, and the levels of one split.
FINEST, STEP = 24, 3
#: Points of interest of a leaf at least; more where that keeps the directory in bounds.
LEAF, MOST_LEAVES = 24, 200_000
METRES = 1000.0 * V.EARTH_KM


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of 24 to every other place."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """Every other bit."""
    x = x & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> shift)) & mask
    return x


def cell_codes(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Z-order numbers of the finest cells; longitudes are taken into one turn."""
    side = 1 << FINEST
    y = np.clip(np.floor((lat + 90.0) / 180.0 * side), 0, side - 1)
    x = np.clip(np.floor(((lon + 180.0) % 360.0) / 360.0 * side), 0, side - 1)
    return (_spread(y) << 1) | _spread(x)


def _with(df: DataFrame, number: str) -> StructType:
    """The schema of df and a number."""
    return StructType([*df.schema.fields, StructField(number, LongType())])


def _coded(df: DataFrame, lat: str, lon: str, code: str) -> DataFrame:
    at = [df.columns.index(lat), df.columns.index(lon)]

    def run(batches):
        for b in batches:
            codes = cell_codes(*(b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes)], names=[*b.schema.names, code])

    return df.mapInArrow(run, _with(df, code))


def _directory(codes: DataFrame, total: int) -> dict[str, np.ndarray]:
    """The quadtree over a column of codes: nodes from the root down, with level, cell, count and the range of their children; leaves by their first code.

    Each round counts the cells of STEP further levels under those that hold too many.
    No more than total / leaf cells are split in a round, so their children, and all that is collected, are bounded.
    """
    leaf = max(LEAF, -(-total * 4**STEP // MOST_LEAVES))
    level, cell, count = [np.array([0])], [np.array([0], dtype=np.int64)], [np.array([total], dtype=np.int64)]
    first, many = [], []
    spark, at = codes.sparkSession, 0
    while True:
        heavy = np.flatnonzero(count[-1] > leaf) if at < FINEST else np.zeros(0, np.int64)
        begin, size = np.full(len(cell[-1]), -1, dtype=np.int64), np.zeros(len(cell[-1]), dtype=np.int64)
        if len(heavy):
            over = FINEST - at
            split = spark.createDataFrame(pa.table({"cell": cell[-1][heavy]}))
            own = codes.withColumn("cell", F.shiftright("code", 2 * over)).join(F.broadcast(split), "cell", "left_semi")  # total / leaf rows at most
            found = own.groupBy(F.shiftright("code", 2 * (over - STEP)).alias("cell")).agg(F.count("*").alias("n")).toArrow()
            found = found.sort_by("cell")
            cells = found.column("cell").to_numpy().astype(np.int64)
            base = sum(map(len, cell))
            parent = cells >> (2 * STEP)
            begin[heavy] = base + np.searchsorted(parent, cell[-1][heavy], "left")
            size[heavy] = np.searchsorted(parent, cell[-1][heavy], "right") - np.searchsorted(parent, cell[-1][heavy], "left")
        first.append(begin)
        many.append(size)
        if not len(heavy):
            break
        at += STEP
        level.append(np.full(len(cells), at))
        cell.append(cells)
        count.append(found.column("n").to_numpy().astype(np.int64))
    nodes = {k: np.concatenate(v) for k, v in (("level", level), ("cell", cell), ("count", count), ("first", first), ("many", many))}
    nodes["start"] = nodes["cell"] << (2 * (FINEST - nodes["level"]))
    # A box for each node: its middle, half its height and width, in degrees.
    y, x, width = _gather(nodes["cell"] >> 1), _gather(nodes["cell"]), 360.0 / (1 << nodes["level"])
    nodes |= {"south": y * width / 2 - 90.0, "west": x * width - 180.0, "width": width}
    return nodes


def _chord(a, b, turn):
    """Metres between latitudes a and b, turn apart in longitude (radians)."""
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(turn / 2) ** 2
    return 2 * METRES * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def box_bounds(lat, lon, south, west, width):
    """(no nearer than, no farther than) in metres, of points to boxes of that width and half that height; all in degrees."""
    a, s, n = np.radians(lat), np.radians(south), np.radians(south + width / 2)
    into = (lon - west) % 360.0
    inside = into <= width
    # The nearer meridian edge: on it the distance has one minimum, or none between the box's latitudes.
    turn = np.radians(np.minimum(np.where(inside, 0.0, into - width), np.where(inside, 0.0, 360.0 - into)))
    best = np.arctan2(np.sin(a), np.cos(a) * np.cos(turn))
    near = np.minimum(_chord(a, s, turn), _chord(a, n, turn))
    near = np.where((best >= s) & (best <= n), np.minimum(near, _chord(a, best, turn)), near)
    middle, half = (s + n) / 2, np.radians(width) / 2
    low = np.where((s <= 0) & (n >= 0), 0.0, np.minimum(np.abs(s), np.abs(n)))
    reach = METRES * ((n - s) / 2 + half * np.cos(low))
    far = _chord(a, middle, np.radians(lon - west - width / 2)) + reach
    return near * (1 - 1e-9) - 1e-3, far * (1 + 1e-9) + 1e-3


def leaves_of(nodes: dict[str, np.ndarray], lat: np.ndarray, lon: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, nodes): for each point the leaves that can hold one of its k nearest within the radius."""
    point, node = np.arange(len(lat)), np.zeros(len(lat), dtype=np.int64)
    while True:
        many = nodes["many"][node]
        inner = many > 0
        if not inner.any():
            return point, node
        # Inner nodes give way to their children.
        below = np.repeat(nodes["first"][node[inner]], many[inner]) + np.arange(many.sum()) - np.repeat(np.cumsum(many[inner]) - many[inner], many[inner])
        point, node = np.concatenate([point[~inner], np.repeat(point[inner], many[inner])]), np.concatenate([node[~inner], below])
        near, far = box_bounds(lat[point], lon[point], nodes["south"][node], nodes["west"][node], nodes["width"][node])
        order = np.lexsort((far, point))
        point, node, near, far = point[order], node[order], near[order], far[order]
        begin = np.searchsorted(point, np.arange(len(lat)))
        held = np.cumsum(nodes["count"][node])
        held -= np.repeat(np.concatenate([[0], held])[begin], np.diff(np.append(begin, len(point))))
        # The first cell, by its far end, with which there are k within that distance.
        enough = np.flatnonzero(held >= k)
        limit = np.full(len(lat), radius)
        owners, at = np.unique(point[enough], return_index=True)
        limit[owners] = np.minimum(radius, far[enough[at]])
        kept = near <= limit[point]
        point, node = point[kept], node[kept]


def _to_leaves(held, id_at: int, lat_at: int, lon_at: int, k: int, radius: float):
    """Points (id, latitude, longitude) to (id, latitude, longitude, leaf)."""

    def run(batches):
        nodes = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                lat, lon = (b.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in (lat_at, lon_at))
                point, node = leaves_of(nodes, lat, (lon + 180.0) % 360.0 - 180.0, k, radius)
                took = b.take(pa.array(point))
                yield pa.RecordBatch.from_arrays([took.column(id_at), took.column(lat_at), took.column(lon_at), pa.array(node)], names=["id", "latitude", "longitude", "leaf"])

    return run


def _in_leaf(held, code_at: int):
    """Points of interest with the leaf that they lie in."""

    def run(batches):
        nodes = held.value
        leaves = np.flatnonzero(nodes["many"] == 0)
        leaves = leaves[np.argsort(nodes["start"][leaves])]
        starts = nodes["start"][leaves]
        for b in batches:
            at = leaves[np.searchsorted(starts, b.column(code_at).to_numpy(), "right") - 1]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != code_at), pa.array(at)], names=[*(n for i, n in enumerate(b.schema.names) if i != code_at), "leaf"])

    return run


def _known(lat: str, lon: str) -> Column:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return finite(lat) & finite(lon) & F.col(lat).between(-90, 90) & F.col(lon).between(-1e6, 1e6)


def meeting(points: DataFrame, pois: DataFrame, k: int, *, radius_m: float = float("inf"), id: str = "listing_id", carry: tuple[str, ...] = ("name",)) -> DataFrame:
    """(id, d, lat, lon, carry): every point with all that can be among its k nearest of pois within the radius, and with others nearby.

    Points and pois without coordinates, or with a latitude beyond a pole, are left out. Of pois at one place k take part, which
    is as many as can be among the nearest. The directory is built while the plan is.
    """
    spark = points.sparkSession
    double = lambda c: F.col(c).cast("double").alias(c)
    held = pois.select(double("lat"), double("lon"), *carry).where(_known("lat", "lon"))
    at_place = Window.partitionBy("lat", "lon").orderBy(*carry) if carry else Window.partitionBy("lat", "lon").orderBy(F.lit(0))
    held = held.withColumn("at_place", F.row_number().over(at_place)).where(F.col("at_place") <= k).drop("at_place")
    held = written(_coded(held, "lat", "lon", "code"))
    own = points.select(F.col(id).alias("id"), double("latitude"), double("longitude")).where(_known("latitude", "longitude"))
    nodes = spark.sparkContext.broadcast(_directory(held.select("code"), held.count()))
    schema = f"id {points.schema[id].dataType.simpleString()}, latitude double, longitude double, leaf bigint"
    asked = own.mapInArrow(_to_leaves(nodes, 0, 1, 2, k, radius_m + 1.0), schema)
    there = held.mapInArrow(_in_leaf(nodes, held.columns.index("code")), _with(held.drop("code"), "leaf"))
    met = asked.join(there, "leaf").withColumn("d", distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")))
    return met.select(F.col("id").alias(id), "d", "lat", "lon", *carry)


def k_nearest_join(points: DataFrame, pois: DataFrame, k: int, *, radius_m: float = float("inf"), id: str = "listing_id", carry: tuple[str, ...] = ("name",)) -> DataFrame:
    """(id, rank, metres, lat, lon, carry): of every point the k nearest of pois (lat, lon, carry) no farther than the radius, whole metres counting.

    Equally near ones stand by lat, lon and carry, nulls first. Points that repeat an id are one; see meeting() for what is left out.
    """
    once = points.where(_known("latitude", "longitude")).dropDuplicates([id])
    met = meeting(once, pois, k, radius_m=radius_m, id=id, carry=carry)
    w = Window.partitionBy(id).orderBy("d", "lat", "lon", *carry)
    best = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("metres", F.col("d").cast("int")).where(F.col("metres") <= radius_m)
    return best.select(id, "rank", "metres", "lat", "lon", *carry)
