"""Fixtures as the reference tests describe them, and a plain model of stop detection."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

R = 6373.0


def km(a: tuple[float, float], b: tuple[float, float]) -> float:
    if a == b:
        return 0.0
    p, q = math.radians(90 - a[0]), math.radians(90 - b[0])
    c = math.sin(p) * math.sin(q) * math.cos(math.radians(a[1] - b[1])) + math.cos(p) * math.cos(q)
    return math.acos(max(-1.0, min(1.0, c))) * R


def rows(points: list[tuple[datetime, float, float, float]], truck: str = "T1") -> list[tuple]:
    return [(truck, t.strftime("%H:%M:%S"), v, lat, lon, t.month * 31 + t.day, t.isoformat(), t, i) for i, (t, lat, lon, v) in enumerate(points)]


SCHEMA = "truckId string, time string, velocity double, lat double, lon double, dateNum int, timestamp string, ts timestamp, seq long"


def route(stops: int, day: datetime = datetime(2014, 8, 11, 8)) -> list[tuple[datetime, float, float, float]]:
    out, t = [], day
    for s in range(stops):
        lat, lon = 37.4419 + 0.01 * s, -122.1430 + 0.01 * s
        for i in range(15 + 2 * s):
            out.append((t, lat + (i % 3 - 1) * 2e-5, lon + (i % 3 - 1) * 2e-5, 0.0))
            t += timedelta(seconds=45)
        if s < stops - 1:
            for j in range(5):
                p = (j + 1) / 5
                out.append((t, lat + 0.01 * p, lon + 0.01 * p, 30.0 + 5 * j))
                t += timedelta(seconds=60)
    return out


def single(minutes: int) -> list[tuple[datetime, float, float, float]]:
    start = datetime(2014, 8, 11, 9)
    return [(start + timedelta(minutes=i), 37.4419 + (i % 3 - 1) * 2e-5, -122.1430 + (i % 3 - 1) * 2e-5, 0.0) for i in range(minutes + 1)]


def model_stops(points: list[tuple[datetime, float, float, float]], reach: float = 0.02, least: int = 10) -> list[tuple]:
    """(first, last, n, lat, lon, radius) of the stops of one truck and day."""
    clusters, own = [], []
    for p in points:
        if own and km((sum(x[1] for x in own) / len(own), sum(x[2] for x in own) / len(own)), (p[1], p[2])) >= reach:
            clusters.append(own)
            own = []
        own = [*own, p]
    clusters.append(own)
    out = []
    for c in clusters:
        minutes = [t.hour * 60 + t.minute for t, *_ in c]
        if len(c) >= 2 and max(minutes) - min(minutes) >= least:
            radius = max(km((a[1], a[2]), (b[1], b[2])) for a in c for b in c) / 2
            out.append((min(minutes), max(minutes), len(c), sum(x[1] for x in c) / len(c), sum(x[2] for x in c) / len(c), radius))
    return out
