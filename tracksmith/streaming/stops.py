"""Stop detection on a stream, in state of constant size.

The state of a truck's day is its open cluster: how many points, the sums of their places, the first and last second,
and the corners of their convex hull, which are all that the radius needs. A cluster that closes, by a point beyond
its reach, comes out at once; the last one of a day comes out when event time has passed the day's end. Points later
than the watermark are dropped, as a walk cannot be taken back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import STOP_MINUTES, STOP_RADIUS_KM
from ..functions import clock
from ..operators.stops import clock_text, diameter, km_between
from .state import need_rocks

OUTPUT = "dateNum int, truckId string, lat double, lon double, radius double, start string, stop string, points long, minutes double"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_STATE = "n long, lat double, lon double, first long, last long, ends long, lats array<double>, lons array<double>"
#: New corners that a hull may hold before it is made anew.
SPARE = 64


def hull(lats: list[float], lons: list[float]) -> tuple[list[float], list[float]]:
    """The corners of the points' convex hull: the farthest two points of any place on earth are among them.

    Points are seen from the earth's centre on the plane that touches it at the first one, where great circles are
    straight, so this holds for points within a quarter of the earth's girth.
    """
    both = sorted(set(zip(lats, lons, strict=True)))
    if len(both) < 3:
        return [p[0] for p in both], [p[1] for p in both]
    at, to = math.radians(lats[0]), math.radians(lons[0])

    def seen(lat: float, lon: float) -> tuple[float, float]:
        p, q = math.radians(lat), math.radians(lon) - to
        depth = math.sin(at) * math.sin(p) + math.cos(at) * math.cos(p) * math.cos(q)
        return math.cos(p) * math.sin(q) / depth, (math.cos(at) * math.sin(p) - math.sin(at) * math.cos(p) * math.cos(q)) / depth

    places = sorted((*seen(*p), *p) for p in both)

    def side(points: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    corners = side(places) + side(places[::-1])
    return [c[2] for c in corners], [c[3] for c in corners]


class Open:
    """A truck's open cluster."""

    def __init__(self, values: tuple | None = None) -> None:
        self.n, self.lat, self.lon, self.first, self.last, self.ends, self.lats, self.lons = values or (0, 0.0, 0.0, 0, 0, 0, [], [])
        self.lats, self.lons = list(self.lats), list(self.lons)

    def values(self) -> tuple:
        self.lats, self.lons = hull(self.lats, self.lons)
        return self.n, self.lat, self.lon, self.first, self.last, self.ends, self.lats, self.lons

    def reaches(self, lat: float, lon: float, reach: float) -> bool:
        return bool(self.n) and km_between(self.lat / self.n, self.lon / self.n, lat, lon) < reach

    def take(self, lat: float, lon: float, sec: int, ends: int) -> None:
        self.first, self.last = (min(self.first, sec), max(self.last, sec)) if self.n else (sec, sec)
        self.n, self.lat, self.lon, self.ends = self.n + 1, self.lat + lat, self.lon + lon, ends
        self.lats.append(lat)
        self.lons.append(lon)
        if len(self.lats) > 2 * SPARE and len(self.lats) % SPARE == 0:
            self.lats, self.lons = hull(self.lats, self.lons)

    def stop(self, truck: str, day: int, least: float) -> list[tuple]:
        """The row that the cluster gives as it closes, if it is a stop."""
        if self.n < 2 or self.last // 60 - self.first // 60 < least:
            return []
        radius = diameter(np.array(self.lats), np.array(self.lons)) / 2
        return [(day, truck, self.lat / self.n, self.lon / self.n, radius, clock_text(self.first), clock_text(self.last), self.n, float(self.last // 60 - self.first // 60))]


class StopWalk(StatefulProcessor):
    def __init__(self, reach_km: float, least_minutes: float) -> None:
        self.reach, self.least = reach_km, least_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        truck, day = key
        now, found = Open(self.open.get()), []
        before = now.ends
        points = pd.concat(list(rows)).sort_values(["ts", "seq"])  # a truck's points of one batch
        for lat, lon, sec, ends in zip(points.lat.tolist(), points.lon.tolist(), points.sec.tolist(), points.ends.tolist(), strict=True):
            if now.n and not now.reaches(lat, lon, self.reach):
                found += now.stop(truck, day, self.least)
                now = Open()
            now.take(lat, lon, int(sec), int(ends))
        self.open.update(now.values())
        if now.ends != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(max(now.ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(found, columns=_NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        truck, day = key
        found = Open(self.open.get()).stop(truck, day, self.least) if self.open.exists() else []
        self.open.clear()
        yield pd.DataFrame(found, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_stops(points: DataFrame, late: str = "10 minutes", reach_km: float = STOP_RADIUS_KM, least_minutes: float = STOP_MINUTES) -> DataFrame:
    """Stops from a stream of truck points (truckId, dateNum, ts, seq, time, lat, lon)."""
    need_rocks(points.sparkSession)
    end_of_day = (F.unix_seconds(F.date_trunc("day", F.col("ts"))) + 86_400) * 1000
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withWatermark("ts", late)
    timed = placed.select("truckId", "dateNum", "ts", "seq", "lat", "lon", clock.seconds("time").alias("sec"), end_of_day.alias("ends"))
    return timed.groupBy("truckId", "dateNum").transformWithStateInPandas(StopWalk(reach_km, least_minutes), OUTPUT, "append", "EventTime")
