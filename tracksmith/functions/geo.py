"""Distances, boxes and grid cells as Column expressions.

Distances use the spherical law of cosines; equal points are 0 apart, null coordinates give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CITY_LAT, CITY_LON, CITY_RADIUS_KM, DEGREE_METRES, EARTH_KM, EARTH_M, EARTH_MILES

_RAD = math.pi / 180


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def arc(lat1: Column | str | float, lon1: Column | str | float, lat2: Column | str | float, lon2: Column | str | float) -> Column:
    """The angle between two points, in radians."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    p1, p2 = (F.lit(90.0) - lat1) * _RAD, (F.lit(90.0) - lat2) * _RAD
    cosine = F.sin(p1) * F.sin(p2) * F.cos(lon1 * _RAD - lon2 * _RAD) + F.cos(p1) * F.cos(p2)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known & (lat1 == lat2) & (lon1 == lon2), 0.0).when(known, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


Distance = Callable[..., Column]


def kilometres(*at: Column | str | float) -> Column:
    return arc(*at) * EARTH_KM


def miles(*at: Column | str | float) -> Column:
    return arc(*at) * EARTH_MILES


def metres(*at: Column | str | float) -> Column:
    return arc(*at) * EARTH_M


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column, root: bool = False) -> Column:
    """Squared distance in the plane, or its root."""
    squared = F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0))
    return F.sqrt(squared) if root else squared


def to_metres(degrees: Column | str) -> Column:
    return _col(degrees) * DEGREE_METRES


def to_degrees(value: Column | str) -> Column:
    return _col(value) / DEGREE_METRES


def unpack(value: Column | str) -> Column:
    """Degrees from whole numbers with ten decimals."""
    return _col(value) / 1e10


def inside(lat: Column | str = "lat", lon: Column | str = "lon", centre: tuple[float, float] = (CITY_LAT, CITY_LON), radius_km: float = CITY_RADIUS_KM) -> Column:
    """Whether a point lies within the circle, its edge not included."""
    return kilometres(lat, lon, *centre) < radius_km


def within_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float, lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max)


def near(df: DataFrame, lat: float, lon: float, metres_most: float, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Rows within the distance, with it, nearest first. A box on the raw columns goes before the distance, as scans can use it."""
    reach = metres_most / EARTH_M / _RAD * 1.000001
    wide = 180.0 if abs(lat) + reach >= 90 else math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * 1.000001
    box = F.col(at[0]).between(lat - reach, lat + reach)
    if wide < 180 and abs(lon) + wide <= 180:
        box &= F.col(at[1]).between(lon - wide, lon + wide)
    return df.where(box).withColumn("distance_m", metres(*at, lat, lon)).where(F.col("distance_m") <= metres_most).orderBy("distance_m")


def cell(value: Column | str, least: Column | float, metres_wide: float) -> Column:
    """The number of a grid cell along one axis."""
    return F.floor((_col(value) - _col(least)) * DEGREE_METRES / metres_wide).cast("long")


def point(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    return F.struct(_col(lat).alias("lat"), _col(lon).alias("lon"))


def geojson(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(_col(lon), _col(lat)).alias("coordinates"))


def sphere_cell(side_km: float, lat: str = "lat", lon: str = "lon") -> list[Column]:
    """x, y, z: a point's cell in a cubic grid through the earth. Points within side_km lie in the same cell or in touching ones, at poles and date line too."""
    p, q = F.radians(lat), F.radians(lon)
    axes = F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)
    return [F.floor(a * EARTH_KM / (side_km * 1.001 + 1e-6)).alias(n) for a, n in zip(axes, "xyz", strict=True)]


def around(cells: DataFrame) -> DataFrame:
    """Each row once for its cell (x, y, z) and for each of the 26 that touch it, with the steps i, j, k there."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    moved = cells.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j")).select("*", F.explode(steps).alias("k"))
    return moved.withColumns({a: F.col(a) + F.col(b) for a, b in zip("xyz", "ijk", strict=True)})
