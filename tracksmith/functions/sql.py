"""SQL names for the scalar functions: their bodies are SQL, so Catalyst takes them into the plan."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from ..config import EARTH_KM, EARTH_M, EARTH_MILES
from .units import ALTITUDE, SPEED

_RAD = repr(math.pi / 180)


def _arc() -> str:
    p = lambda v: f"((90D - {v}) * {_RAD}D)"
    cosine = f"sin({p('lat1')}) * sin({p('lat2')}) * cos(lon1 * {_RAD}D - lon2 * {_RAD}D) + cos({p('lat1')}) * cos({p('lat2')})"
    return f"CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN 0D ELSE acos(least(1D, greatest(-1D, {cosine}))) END"


def _hms(out: str) -> str:
    part = lambda k: f"CAST(split(t, ':')[{k}] AS INT)"
    return out.format(h=part(0), m=part(1), s=part(2))


def register(spark: SparkSession) -> list[str]:
    """Defines the functions for this session and returns their names."""
    four, choose = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", lambda table: " ".join(f"WHEN '{u}' THEN {f!r}D" for u, f in table.items())
    bodies = {
        "kil_dist": (four, "DOUBLE", f"({_arc()}) * {EARTH_KM!r}D"),
        "mile_dist": (four, "DOUBLE", f"({_arc()}) * {EARTH_MILES!r}D"),
        "meter_dist": (four, "DOUBLE", f"({_arc()}) * {EARTH_M!r}D"),
        "date_num": ("ts TIMESTAMP", "INT", "month(ts) * 31 + dayofmonth(ts)"),
        "clock_time": ("t STRING", "STRING", _hms("concat({h}, ':', {m})")),
        "clock_seconds": ("t STRING", "INT", _hms("{h} * 3600 + {m} * 60 + {s}")),
        "clock_minutes": ("t STRING", "INT", _hms("{h} * 60 + {m}")),
        "clock_hours": ("t STRING", "DOUBLE", _hms("{h} + {m} / 60D + {s} / 3600D")),
        "speed_to_mps": ("v DOUBLE, unit STRING", "DOUBLE", f"v * CASE lower(unit) {choose(SPEED)} ELSE raise_error('Unknown speed unit') END"),
        "altitude_to_m": ("v DOUBLE, unit STRING", "DOUBLE", f"v * CASE lower(unit) {choose(ALTITUDE)} ELSE raise_error('Unknown altitude unit') END"),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(bodies)
