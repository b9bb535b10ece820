"""Validation of track points: each rule is an expression; rows are never dropped here, they get an error or flags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUTURE_DAYS, HDOP_SOFT_CAP, SPEED_CAP_MPS

REQUIRED = ("device_id", "ts_utc", "lat", "lon")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(value: Column | str) -> Column:
    """A double; NaN counts as null, as a blank cell does."""
    d = _col(value).try_cast("double")
    return F.when(~F.isnan(d), d)


def required(**given: Column) -> Column:
    """The first message about missing fields, or null."""
    missing = [F.when(given[f].isNull(), f"Missing required field: {f}") for f in REQUIRED]
    return F.coalesce(*missing, F.when(F.trim(given["device_id"]) == "", "device_id cannot be empty"))


def coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(
        F.when(~lat.between(-90.0, 90.0), F.concat(F.lit("Latitude "), lat.cast("string"), F.lit(" out of range [-90, 90]"))),
        F.when(~lon.between(-180.0, 180.0), F.concat(F.lit("Longitude "), lon.cast("string"), F.lit(" out of range [-180, 180]"))),
    )


def time(ts: Column, as_of: datetime | Column | None = None) -> Column:
    """Times lie from 1970 to two days after as_of (default: now)."""
    now = F.current_timestamp() if as_of is None else _as_time(as_of)
    return F.coalesce(
        F.when(ts < F.lit("1970-01-01 00:00:00").cast("timestamp"), F.concat(F.lit("Timestamp "), ts.cast("string"), F.lit(" is before 1970-01-01"))),
        F.when(ts > now + F.expr(f"INTERVAL {FUTURE_DAYS} DAYS"), F.concat(F.lit("Timestamp "), ts.cast("string"), F.lit(f" is more than {FUTURE_DAYS} days in the future"))),
    )


def _as_time(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def speed(value: Column) -> tuple[Column, Column]:
    bad = (value < 0) | (value > SPEED_CAP_MPS)
    return F.when(~bad, value), F.coalesce(bad, F.lit(False))


def heading(value: Column) -> tuple[Column, Column]:
    bad = (value < 0) | (value >= 360)
    return F.when(~bad, value), F.coalesce(bad, F.lit(False))


def hdop(value: Column) -> tuple[Column, Column]:
    """Negative values go; large ones stay, but both are flagged."""
    return F.when(value >= 0, value), F.coalesce((value < 0) | (value > HDOP_SOFT_CAP), F.lit(False))


def flags(**raised: Column) -> Column:
    """The raised flags as a map; null if none is."""
    found = F.map_filter(F.create_map(*[x for k, c in raised.items() for x in (F.lit(k), c)]), lambda _, v: v)
    return F.when(F.size(found) > 0, found)


def point_hash(device: Column | str, ts: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """SHA-256 of device:time:lat:lon; the time in UTC, micros only if there are any, coordinates with six decimals."""
    ts = _col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.sha2(F.concat_ws(":", _col(device), said, F.format_string("%.6f", _col(lat)), F.format_string("%.6f", _col(lon))), 256)
