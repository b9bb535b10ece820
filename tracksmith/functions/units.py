"""Speeds to metres a second, altitudes to metres; the factor is chosen when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of the units, by their lower-case names.
SPEED = {"mps": 1.0, "kph": 1 / 3.6, "mph": 0.44704, "knots": 0.514444}
ALTITUDE = {"m": 1.0, "ft": 0.3048, "km": 1000.0}


def _converted(value: Column | str, unit: str, factors: dict[str, float], what: str) -> Column:
    if unit.lower() not in factors:
        raise ValueError(f"Unknown {what} unit: {unit}")
    return (F.col(value) if isinstance(value, str) else value).cast("double") * factors[unit.lower()]


def speed_mps(value: Column | str, unit: str) -> Column:
    return _converted(value, unit, SPEED, "speed")


def altitude_m(value: Column | str, unit: str) -> Column:
    return _converted(value, unit, ALTITUDE, "altitude")
