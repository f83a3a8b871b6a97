"""Distances on the sphere as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import values as V


def _half_chord(lat1, lng1, lat2, lng2) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin((F.radians(lng2) - F.radians(lng1)) / 2) ** 2


def distance_km(lat1, lng1, lat2, lng2) -> Column:
    h = _half_chord(lat1, lng1, lat2, lng2)
    return 2 * V.EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def distance_m(lat1, lng1, lat2, lng2) -> Column:
    return 2000 * V.EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(_half_chord(lat1, lng1, lat2, lng2))))


def in_box(lat: Column, lng: Column, lat0: Column, lng0: Column, radius_km: Column) -> Column:
    """A box around the circle: plain ranges, which a scan's statistics can use."""
    dlat = radius_km / 111.0
    dlng = F.when(F.abs(lat0) + dlat < 89.0, radius_km / (111.0 * F.cos(F.radians(F.abs(lat0) + dlat)))).otherwise(360.0)
    return lat.between(lat0 - dlat, lat0 + dlat) & lng.between(lng0 - dlng, lng0 + dlng)


def place_code(lat: Column, lng: Column) -> Column:
    """Places that are near have near numbers: 16 bits each of latitude and longitude, bit by bit in turn (Z-order). Null without coordinates."""

    def spread(share: Column) -> Column:
        x = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 65535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    return F.when(lat.isNotNull() & lng.isNotNull(), F.shiftleft(spread((lat + 90) / 180), 1).bitwiseOR(spread((lng + 180) / 360)))


def boxes(rows: list[tuple[float, float, float]], lat: Column, lng: Column, most: int = 32) -> Column:
    """Plain ranges that hold all circles (latitude, longitude, radius in km): one for each of a few, one around all of many. A scan can drop row groups by them."""
    found = []
    for lat0, lng0, radius in rows:
        up = radius / 111.0 * (1 + 1e-9)
        side = up / math.cos(math.radians(abs(lat0) + up)) if abs(lat0) + up < 89.0 else 360.0
        found.append((lat0 - up, lat0 + up, lng0 - side, lng0 + side))
    if len(found) > most:
        found = [(*(f(x[i] for x in found) for f, i in ((min, 0), (max, 1), (min, 2), (max, 3))),)]
    return reduce(lambda a, b: a | b, (lat.between(s, n) & lng.between(w, e) for s, n, w, e in found))


def decay(metres: Column, tau: float) -> Column:
    """exp(-d / tau); null where the distance is."""
    return F.exp(-metres / F.lit(tau))
