"""The k-nearest join against all distances."""

import math
import random

import numpy as np
import pytest

from millrace.functions import values
from millrace.operators import geojoin, knn


def _metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2000 * values.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def _plain(points, pois, k, radius=math.inf):
    out = set()
    for i, a, b in points:
        if a is None or b is None or not -90 <= a <= 90:
            continue
        near = sorted((_metres(a, b, c, d), c, d, name) for c, d, name in pois if c is not None and d is not None and -90 <= c <= 90)
        out |= {(i, n, int(m), name) for n, (m, _, _, name) in enumerate(near[:k], 1) if int(m) <= radius}
    return out


def _join(spark, points, pois, k, radius=math.inf):
    own = spark.createDataFrame(points, "listing_id bigint, latitude double, longitude double").repartition(4)
    held = spark.createDataFrame(pois, "lat double, lon double, name string").repartition(3)
    return {(r.listing_id, r["rank"], r.metres, r.name) for r in knn.k_nearest_join(own, held, k, radius_m=radius).collect()}


def _clustered(rng, n):
    """Dense towns, one place many times over, a sparse rest, both poles and the date line."""
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            out.append((47.0 + rng.gauss(0, 1e-4), 8.0 + rng.gauss(0, 1e-4), f"town{i}"))
        elif kind < 0.55:
            out.append((46.5, 7.5, f"same{i}"))
        elif kind < 0.7:
            out.append((rng.uniform(-90, 90), rng.uniform(-180, 180), f"far{i}"))
        elif kind < 0.8:
            out.append((rng.choice((-1, 1)) * rng.uniform(89.9, 90), rng.uniform(-180, 180), f"pole{i}"))
        else:
            out.append((rng.uniform(-1, 1), rng.choice((-180.0, 180.0, 179.999, -179.999, 181.0)), f"line{i}"))
    return out


@pytest.mark.parametrize(("k", "n", "radius"), [(1, 400, math.inf), (3, 900, math.inf), (5, 40, 2_000_000.0), (7, 3, math.inf), (2, 600, 50.0)])
def test_join(spark, monkeypatch, k, n, radius):
    monkeypatch.setattr(knn, "LEAF", 4)
    rng = random.Random(n)
    pois = [*_clustered(rng, n), (None, 8.0, "a"), (47.0, None, "b"), (91.0, 0.0, "c")]
    points = [(i, a, b) for i, (a, b, _) in enumerate(_clustered(rng, 150))] + [(1000, None, 8.0), (1001, 95.0, 8.0), (1002, float("nan"), 8.0)]
    assert _join(spark, points, pois, k, radius) == _plain([p for p in points if p[1] is None or p[1] == p[1]], pois, k, radius)


def test_directory_stays_in_bounds(spark, monkeypatch):
    """However many points of interest, the directory has a bounded number of nodes; results stay whole."""
    monkeypatch.setattr(knn, "LEAF", 1)
    monkeypatch.setattr(knn, "MOST_LEAVES", 640)
    rng = random.Random(3)
    pois, points = _clustered(rng, 800), [(i, a, b) for i, (a, b, _) in enumerate(_clustered(rng, 60))]
    codes = spark.createDataFrame([(int(c),) for c in knn.cell_codes(np.array([p[0] for p in pois]), np.array([p[1] for p in pois]))], "code bigint")
    assert len(knn._directory(codes, 800)["cell"]) <= 640 * knn.FINEST // knn.STEP
    assert _join(spark, points, pois, 3) == _plain(points, pois, 3)


def test_box_bounds():
    """No point of a box is nearer or farther than its bounds say."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        width = 360.0 / (1 << int(rng.integers(0, 20)))
        south = -90 + width / 2 * int(rng.integers(0, round(360 / width)))
        west = -180 + width * int(rng.integers(0, round(360 / width)))
        lat, lon = rng.uniform(-90, 90, 20), rng.uniform(-180, 180, 20)
        near, far = knn.box_bounds(lat, lon, np.full(20, south), np.full(20, west), np.full(20, width))
        at = rng.uniform(south, south + width / 2, 200), rng.uniform(west, west + width, 200)
        d = knn._chord(np.radians(lat)[:, None], np.radians(at[0])[None, :], np.radians(at[1][None, :] - lon[:, None]))
        assert (d >= near[:, None] - 0.01).all() and (d <= far[:, None] + 0.01).all()


def test_empty_and_many_points(spark, monkeypatch):
    assert _join(spark, [(1, 47.0, 8.0)], [], 3) == set()
    assert _join(spark, [], [(47.0, 8.0, "a")], 3) == set()
    monkeypatch.setattr(geojoin, "MOST_POINTS", 2)
    points = spark.createDataFrame([(i, 47.0 + i / 100, 8.0) for i in range(5)], "point_id bigint, latitude double, longitude double")
    pois = spark.createDataFrame([(47.0 + i / 90, 8.0, f"n{i}", "x") for i in range(9)], "lat double, lon double, name string, kind string")
    many = {tuple(r) for r in geojoin.k_nearest(points, pois, 2, 1500.0).collect()}
    monkeypatch.setattr(geojoin, "MOST_POINTS", 10)
    assert many == {tuple(r) for r in geojoin.k_nearest(points, pois, 2, 1500.0).collect()} and many


def test_plan_of_many_stays_small(spark, monkeypatch):
    """Above MOST_BROADCAST points of interest the plan has a join a type, and ties fall as they do for few."""
    rng = random.Random(9)
    points = spark.createDataFrame([(str(i), 46 + rng.randrange(20) / 10, 6 + rng.randrange(40) / 10) for i in range(40)] + [("far", -60.0, -170.0), ("none", None, 7.0)], "listing_id string, latitude double, longitude double")
    pois = spark.createDataFrame([(rng.choice(["a", "b", None]), 46 + rng.randrange(20) / 10, 6 + rng.randrange(40) / 10, f"n{rng.randrange(1000)}") for _ in range(150)], "poi_type string, lat double, lon double, name string")
    few = {tuple(r) for r in geojoin.nearest(points, pois, carry=("name",)).collect()}
    monkeypatch.setattr(geojoin, "MOST_BROADCAST", 10)
    many = geojoin.nearest(points, pois, carry=("name",))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert {tuple(r) for r in many.collect()} == few and len(few) == 2 * 41
