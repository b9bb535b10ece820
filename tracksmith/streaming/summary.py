"""Distance, time on road, speed and frequency of every truck and day, kept up to date on a stream.

The state of a truck's day is its last point and a few sums, whatever the day holds. A batch's points are taken in
order of time; one that comes before the last point of an earlier batch would change what has been summed, and goes
to a side table instead. repaired() makes the days of that table anew from the stored points. A day's state goes
`keep_days` after its end, by event time; points that come later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import EARTH_KM
from ..functions import clock
from ..operators import metrics
from ..operators.store import Tables
from .state import need_rocks

KEY = ["truckId", "dateNum"]
_SUMS = ["points", "km", "road", "secs", "steps"]
_POINT = ["ts", "seq", "lat", "lon", "sec"]
_STATE = "points long, km double, road long, secs long, steps long, ts long, seq long, lat double, lon double, sec long"
OUTPUT = "late boolean, truckId string, dateNum int, points long, km double, road long, secs long, steps long, ts long, seq long, time string, lat double, lon double"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
DAY_MS = 86_400_000


def steps_km(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """From each place to the next, as metrics.segments() has it; unknown places give nan."""
    p, q = np.radians(90.0 - lat), np.radians(lon)
    cosine = np.sin(p[:-1]) * np.sin(p[1:]) * np.cos(q[:-1] - q[1:]) + np.cos(p[:-1]) * np.cos(p[1:])
    same = (lat[:-1] == lat[1:]) & (lon[:-1] == lon[1:])
    return np.where(same, 0.0, np.arccos(np.clip(cosine, -1.0, 1.0)) * EARTH_KM)


class Sums(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getValueState("sums", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        truck, day = key
        points = pd.concat(list(rows)).sort_values(["ts", "seq"])  # a truck's points of one batch
        late = points.iloc[:0]
        last = dict(zip([*_SUMS, *_POINT], self.sums.get(), strict=True)) if self.sums.exists() else dict.fromkeys(_SUMS, 0)
        if "ts" not in last and len(points):
            self.handle.registerTimer((int(points.ts.min()) // (1000 * DAY_MS) + 1) * DAY_MS + self.keep_ms)
        if "ts" in last:
            before = (points.ts < last["ts"]) | ((points.ts == last["ts"]) & (points.seq < last["seq"]))
            late, points = points[before], points[~before]
        if len(points):
            first = [last] if "ts" in last else []
            lat, lon = (np.array([*(x[c] for x in first), *points[c]], float) for c in ("lat", "lon"))
            sec = np.diff(np.array([*(x["sec"] for x in first), *points.sec], np.int64))
            km = steps_km(lat, lon)
            made = (last["points"] + len(points), last["km"] + float(np.nansum(km)), last["road"] + int(sec[km > 0].sum()), last["secs"] + int(sec.sum()), last["steps"] + len(sec))
            end = points.iloc[-1]
            self.sums.update((*(type(x)(x) for x in made), int(end.ts), int(end.seq), float(end.lat), float(end.lon), int(end.sec)))
            yield pd.DataFrame([(False, truck, day, *made, None, None, None, None, None)], columns=_NAMES)
        if len(late):
            yield late.assign(late=True, truckId=truck, dateNum=day, **dict.fromkeys(_SUMS))[_NAMES]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sums.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def stream_summary(points: DataFrame, keep_days: float = 7) -> DataFrame:
    """From a stream of truck points: a row with the day's sums so far for each truck and day of a batch, and the late points (`late`)."""
    need_rocks(points.sparkSession)
    timed = points.withColumn("event", F.col("ts")).withWatermark("event", f"{int(keep_days * 24 * 60)} minutes")
    rows = timed.select(*KEY, F.unix_micros("ts").alias("ts"), "seq", "time", "lat", "lon", clock.seconds("time").cast("long").alias("sec"), "event")
    return rows.groupBy(*KEY).transformWithStateInPandas(Sums(int(keep_days * DAY_MS)), OUTPUT, "update", "EventTime")


def told(sums: DataFrame) -> DataFrame:
    """The measures of metrics.summary() from a day's sums."""
    hours = F.col("road") / 3600.0
    return sums.select(*KEY, "points", F.col("km").alias("distance_km"), hours.alias("road_hours"), F.try_divide("secs", "steps").alias("frequency_s"), F.try_divide(F.col("km"), hours).alias("avg_kmh"))


def start_summary(store: Tables, points: DataFrame, checkpoint: str, keep_days: float = 7, once: bool = False, trigger: str = "10 seconds") -> StreamingQuery:
    """Keeps the tables day_sums and late_points; a batch that is done again after a failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.upsert("day_sums", batch.where("not late").select(*KEY, *_SUMS), KEY, "points")
            store.upsert("late_points", batch.where("late").select(*KEY, F.timestamp_micros("ts").alias("ts"), "seq", "time", "lat", "lon"), [*KEY, "ts", "seq"], "seq")
        finally:
            batch.unpersist()

    writer = stream_summary(points, keep_days).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def repaired(sums: DataFrame, late: DataFrame, points: DataFrame) -> DataFrame:
    """The days' measures, with those of the late points' days made anew from all points."""
    days = late.select(*KEY).distinct()
    again = metrics.summary(points.join(days, KEY, "left_semi"))
    return told(sums).join(days, KEY, "left_anti").unionByName(again.select(*KEY, "points", "distance_km", "road_hours", "frequency_s", "avg_kmh"))
