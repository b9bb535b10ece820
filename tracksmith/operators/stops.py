"""Stop detection, merging of stops over trucks, and the stop tables.

Detection walks each truck and day in order of time and holds a running centroid, so it is the one step that no
window can express. Rows are shuffled once by truck and day, sorted, and streamed through Python in Arrow batches;
a task holds one cluster at a time. Merging is greedy in the order of days and trucks and runs as a few rounds of joins
on grid cells and of tiles settled each by one task; new days are merged into stored stops without the old ones' rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EARTH_KM, STOP_MINUTES, STOP_RADIUS_KM
from ..functions import clock
from ..functions.geo import Distance, around, kilometres, sphere_cell
from .graph import Rounds, saved
from .lookups import numbered

_RAD = math.pi / 180


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    if lat1 == lat2 and lon1 == lon2:
        return 0.0
    p1, p2 = (90.0 - lat1) * _RAD, (90.0 - lat2) * _RAD
    c = math.sin(p1) * math.sin(p2) * math.cos(lon1 * _RAD - lon2 * _RAD) + math.cos(p1) * math.cos(p2)
    return math.acos(min(1.0, max(-1.0, c))) * EARTH_KM


def km_from(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p1, p2 = (90.0 - lat) * _RAD, (90.0 - lats) * _RAD
    c = np.sin(p1) * np.sin(p2) * np.cos(lon * _RAD - lons * _RAD) + np.cos(p1) * np.cos(p2)
    return np.where((lats == lat) & (lons == lon), 0.0, np.arccos(np.clip(c, -1.0, 1.0)) * EARTH_KM)


@dataclass(frozen=True)
class Measure:
    """A distance that keeps the triangle's rule: of one pair of points, and from one point to many."""

    pair: Callable[[float, float, float, float], float] = km_between
    many: Callable[[float, float, np.ndarray, np.ndarray], np.ndarray] = km_from


ARC = Measure()


def clock_text(seconds: int) -> str:
    """Hours and minutes without padding: "8:5"."""
    return f"{seconds // 3600}:{seconds // 60 % 60}"


def diameter(lats: np.ndarray, lons: np.ndarray, many: Callable[..., np.ndarray] = km_from) -> float:
    """The largest distance of two points. A point takes part only if it lies far enough out to be in a farther pair."""
    both = np.unique(np.stack([lats, lons], 1), axis=0)
    if len(both) < 2:
        return 0.0
    out = many(both[:, 0].mean(), both[:, 1].mean(), both[:, 0], both[:, 1])
    best = float(many(*both[out.argmax()], both[:, 0], both[:, 1]).max())
    both = both[out >= best - out.max() - 1e-5]
    for lat, lon in both:
        best = max(best, float(many(lat, lon, both[:, 0], both[:, 1]).max()))
    return best


class Walk:
    """The state of one truck and day: the open cluster's size, sums and number."""

    def __init__(self, reach: float, pair: Callable[[float, float, float, float], float] = km_between) -> None:
        self.pair = pair
        self.reach, self.n, self.lat, self.lon, self.cluster = reach, 0, 0.0, 0.0, 0

    def take(self, lat: float, lon: float) -> int:
        """The cluster that the next point joins: the open one if it is nearer to its centroid than the reach, else a new one."""
        if self.n and self.pair(self.lat / self.n, self.lon / self.n, lat, lon) < self.reach:
            self.n, self.lat, self.lon = self.n + 1, self.lat + lat, self.lon + lon
        else:
            self.n, self.lat, self.lon, self.cluster = 1, lat, lon, self.cluster + 1
        return self.cluster


def _by_truck_day(points: DataFrame, *more: str) -> DataFrame:
    rows = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("truckId", "dateNum", "ts", "seq", "lat", "lon", *more)
    return rows.repartition("truckId", "dateNum").sortWithinPartitions("truckId", "dateNum", "ts", "seq")


def assign_clusters(points: DataFrame, reach_km: float = STOP_RADIUS_KM, measure: Measure = ARC) -> DataFrame:
    """truckId, dateNum, seq, lat, lon and the number of the cluster that each point falls into."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Walk(reach_km, measure.pair)
        for batch in batches:
            found = []
            for truck, day, lat, lon in zip(batch.truckId, batch.dateNum, batch.lat.tolist(), batch.lon.tolist(), strict=True):
                if key != (truck, day):
                    key, state = (truck, day), Walk(reach_km, measure.pair)
                found.append(state.take(lat, lon))
            yield batch.drop(columns="ts").assign(cluster=found)

    return _by_truck_day(points).mapInPandas(walk, "truckId string, dateNum int, seq long, lat double, lon double, cluster int")


def find_stops(points: DataFrame, reach_km: float = STOP_RADIUS_KM, least_minutes: float = STOP_MINUTES, sample_minutes: float | None = None, measure: Measure = ARC, said: Callable[[int], str] = clock_text) -> DataFrame:
    """Stops of every truck and day: dateNum, truckId, cluster, lat, lon, radius, start, stop, points, minutes.

    Clusters of two points or more stay if they last the least minutes. Minutes are those of the clock strings, with
    seconds cut off, and the radius is half the diameter. With sample_minutes the simple form holds instead: minutes
    are points times it, and the radius is the largest distance to the centroid. `measure` is the distance, `said` gives
    start and stop from seconds of the day.
    """

    def stop(key: tuple, number: int, rows: list[tuple]) -> tuple | None:
        n = len(rows)
        if n < 2 and sample_minutes is None:
            return None
        times = [r[2] for r in rows]
        first, last = min(times), max(times)
        took = float(last // 60 - first // 60) if sample_minutes is None else n * sample_minutes
        if took < least_minutes:
            return None
        lats, lons = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        lat, lon = sum(lats.tolist()) / n, sum(lons.tolist()) / n
        radius = diameter(lats, lons, measure.many) / 2 if sample_minutes is None else float(measure.many(lat, lon, lats, lons).max())
        return key[1], key[0], number, lat, lon, radius, said(first), said(last), n, took

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["dateNum", "truckId", "cluster", "lat", "lon", "radius", "start", "stop", "points", "minutes"]
        key, state, rows, number = None, Walk(reach_km, measure.pair), [], 0
        for batch in batches:
            found = []
            for truck, day, lat, lon, sec in zip(batch.truckId, batch.dateNum, batch.lat.tolist(), batch.lon.tolist(), batch.sec.tolist(), strict=True):
                if key != (truck, day):
                    found += [stop(key, number, rows)] if rows else []
                    key, state, rows, number = (truck, day), Walk(reach_km, measure.pair), [], 1
                at = state.take(lat, lon)
                if at != number:
                    found.append(stop(key, number, rows))
                    rows = []
                number = at
                rows.append((lat, lon, sec))
            yield pd.DataFrame([f for f in found if f], columns=names)
        if rows:
            yield pd.DataFrame([f for f in [stop(key, number, rows)] if f], columns=names)

    timed = points.withColumn("sec", clock.seconds("time"))
    return _by_truck_day(timed, "sec").mapInPandas(walk, "dateNum int, truckId string, cluster int, lat double, lon double, radius double, start string, stop string, points long, minutes double")


def find_stops_simple(points: DataFrame, reach_km: float = STOP_RADIUS_KM, least_minutes: float = STOP_MINUTES, sample_minutes: float = 0.5) -> DataFrame:
    return find_stops(points, reach_km, least_minutes, sample_minutes)


#: Grid cells along a tile's side at first, and how that grows from round to round; rows of a tile that one task settles.
TILE, TILE_GROWTH, TILE_ROWS = 32, 8, 200_000
_CELL = ["x", "y", "z"]


def merge_stops(stops: DataFrame, reach_km: float = STOP_RADIUS_KM, exclusive: bool = False, distance: Distance = kilometres, measure: Measure | None = None) -> DataFrame:
    """Members of merged stops: stop_id and anchor with each row of `stops` (find_stops).

    Rows are taken by dateNum, truckId, cluster. A row joins every anchor within reach (the edge included) that comes
    before it, so it may appear more than once; with `exclusive`, only the nearest. A row that none takes becomes an
    anchor. Stops are numbered from 1 in the order of their anchors. `distance` must be no less than kilometres();
    `measure` is the same distance for tasks, known for kilometres().

    The greedy order is settled in rounds over all of the map. First, a row that comes first among the open rows of its
    grid cell and the 26 around it is an anchor, whatever happens elsewhere, and closes the open rows within its
    reach. What is left open is settled tile by tile: a task walks a tile's rows in order and settles all whose
    earlier neighbours it knows; others, which hang on rows over the tile's border, wait for the next round's tiles,
    which are larger and shifted. A round joins cells and anchors, never rows with rows; a tile with more than
    TILE_ROWS open rows is left to the first rule. Without a `measure`, the first rule settles all.
    """
    steps = Rounds(stops.sparkSession)
    try:
        return saved(_members(stops, None, reach_km, exclusive, distance, measure, steps))
    finally:
        steps.close()


def extend_stops(members: DataFrame, new: DataFrame, reach_km: float = STOP_RADIUS_KM, exclusive: bool = False, distance: Distance = kilometres, measure: Measure | None = None) -> tuple[int | None, DataFrame]:
    """(day, rows): what merge_stops() gives from that day on, once the rows of `new` stand beside those of which `members` were made.

    Order is by day first, so nothing that comes before the first new day changes: its anchors are taken as they are,
    and only rows from that day on are merged again. They replace the members of these days; without new rows there
    is no such day. Of rows with the same dateNum, truckId and cluster, the new one stays.
    """
    day = new.agg(F.min("dateNum")).first()[0]
    if day is None:
        return None, members.limit(0)
    key = ["dateNum", "truckId", "cluster"]
    later = members.where(F.col("dateNum") >= day).select(*new.columns).dropDuplicates(key)
    rows = later.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)
    known = members.where(F.col("dateNum") < day).groupBy("stop_id").agg(F.first("anchor_lat").alias("anchor_lat"), F.first("anchor_lon").alias("anchor_lon"))
    steps = Rounds(new.sparkSession)
    try:
        return day, saved(_members(rows, known, reach_km, exclusive, distance, measure, steps).select(*members.columns))
    finally:
        steps.close()


def _reached(anchors: DataFrame, *more: str) -> DataFrame:
    """Each anchor once for every cell that its reach may touch."""
    return around(anchors).select("ao", "anchor_lat", "anchor_lon", *more, *[F.col(c).alias(f"a{c}") for c in _CELL])


def _within(rows: DataFrame, near: DataFrame, reach_km: float, distance: Distance) -> Column:
    same = [rows[c] == near[f"a{c}"] for c in _CELL]
    return same[0] & same[1] & same[2] & (distance("anchor_lat", "anchor_lon", "lat", "lon") <= reach_km)


def _anchors(open_: DataFrame, reach_km: float, distance: Distance, measure: Measure | None, steps: Rounds) -> list[DataFrame]:
    """ao, anchor_lat, anchor_lon and cell of the anchors among the open rows (o, lat, lon, cell), a table for each half of a round."""
    found: list[DataFrame] = []

    def close(anchors: DataFrame) -> DataFrame:
        found.append(steps.keep(anchors.select("ao", "anchor_lat", "anchor_lon", *_CELL)))
        near = _reached(found[-1])
        return steps.keep(open_.join(near, _within(open_, near, reach_km, distance), "left_anti"))

    side, turn, judge = TILE, 0, None
    while not open_.isEmpty():
        first = open_.groupBy(*_CELL).agg(F.min(F.struct("o", "lat", "lon")).alias("m"))
        lowest = around(first).groupBy(*_CELL).agg(F.min("m.o").alias("lowest"))
        chosen = first.join(lowest, _CELL).where("m.o = lowest")
        open_ = close(chosen.select(F.col("m.o").alias("ao"), F.col("m.lat").alias("anchor_lat"), F.col("m.lon").alias("anchor_lon"), *_CELL))
        if measure is None or open_.isEmpty():
            continue
        judge = judge or _judge(open_.sparkSession, reach_km, measure)
        open_ = close(_tile_anchors(open_, side, side // 2 * (turn % 2), judge))
        side, turn = min(side * TILE_GROWTH, 1 << 21), turn + 1
    return found


#: A place as a task compares it: latitude, longitude, sine and cosine of the polar angle, longitude in radians.
Place = tuple[float, float, float, float, float]


def _judge(spark: SparkSession, reach_km: float, measure: Measure) -> Callable[[Place, Place], int]:
    """Whether two places lie within reach: 1 yes, -1 no, 0 where a join might round the other way."""
    if measure is not ARC:
        slack = max(1e-9, 1e-7 / reach_km)

        def by_measure(p: Place, q: Place) -> int:
            gap = measure.pair(p[0], p[1], q[0], q[1])
            return 1 if gap <= reach_km - slack else -1 if gap > reach_km + slack else 0

        return by_measure
    # kilometres() asks for acos(cosine) * EARTH_KM <= reach; Spark itself says from which cosine on that holds.
    ulp, steps = 2.0**-53, 256
    least = F.lit(math.cos(min(math.pi, reach_km / EARTH_KM))) + (F.col("id") - steps) * ulp
    within = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), least))) * EARTH_KM <= reach_km
    sides = spark.range(2 * steps + 1).groupBy(within.alias("within")).agg(F.min(least).alias("low"), F.max(least).alias("high")).collect()
    surely = max([r.high for r in sides if not r.within], default=-2.0)
    maybe = min([r.low for r in sides if r.within], default=2.0)

    def by_cosine(p: Place, q: Place) -> int:
        if p[0] == q[0] and p[1] == q[1]:
            return 1
        cosine = p[2] * q[2] * math.cos(p[4] - q[4]) + p[3] * q[3]
        slack = 0.0 if p[4] == q[4] else 4 * ulp  # the sines and cosines are Spark's own, but for this one
        return 1 if cosine - slack > surely else -1 if cosine + slack < maybe else 0

    return by_cosine


def _tile_anchors(open_: DataFrame, side: int, shift: int, judge: Callable[[Place, Place], int]) -> DataFrame:
    """Anchors that the tiles settle; a tile also sees the open rows that touch its border from outside."""
    polar = (F.lit(90.0) - F.col("lat")) * _RAD
    tiled = open_.withColumns({"s": F.sin(polar), "c": F.cos(polar), "r": F.col("lon") * _RAD})
    for c in _CELL:
        tile = lambda step, c=c: F.floor((F.col(c) + (shift + step)) / side)
        tiled = tiled.withColumn(f"own_{c}", tile(0)).withColumn(f"t{c}", F.explode(F.array_distinct(F.array(tile(-1), tile(0), tile(1)))))
    own = (F.col("own_x") == F.col("tx")) & (F.col("own_y") == F.col("ty")) & (F.col("own_z") == F.col("tz"))
    tiles = ["tx", "ty", "tz"]
    tiled = tiled.select("o", "lat", "lon", "s", "c", "r", *_CELL, *tiles, own.alias("own"))
    crowded = tiled.groupBy(*tiles).count().where(F.col("count") > TILE_ROWS)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        anchors: dict[tuple, list[Place]] = {}
        waiting: dict[tuple, list[Place]] = {}
        out = []
        group = group.sort_values("o")
        for o, lat, lon, s, c, r, x, y, z, mine in zip(*(group[n].tolist() for n in ("o", "lat", "lon", "s", "c", "r", "x", "y", "z", "own")), strict=True):
            here = (lat, lon, s, c, r)
            cells = [(x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
            most = max((judge(a, here) for q in cells for a in anchors.get(q, ())), default=-1)
            if most == 1:
                continue
            if mine and most == -1 and all(judge(w, here) == -1 for q in cells for w in waiting.get(q, ())):
                anchors.setdefault((x, y, z), []).append(here)
                out.append((o, lat, lon, x, y, z))
            else:
                waiting.setdefault((x, y, z), []).append(here)
        return pd.DataFrame(out, columns=["ao", "anchor_lat", "anchor_lon", "x", "y", "z"])

    return tiled.join(crowded, tiles, "left_anti").groupBy(*tiles).applyInPandas(settle, "ao long, anchor_lat double, anchor_lon double, x long, y long, z long")


def _members(stops: DataFrame, known: DataFrame | None, reach_km: float, exclusive: bool, distance: Distance, measure: Measure | None, steps: Rounds) -> DataFrame:
    """known: stop_id, anchor_lat, anchor_lon of anchors that come before all rows."""
    rows = steps.keep(numbered(stops, ["dateNum", "truckId", "cluster"], name="o").select("*", *sphere_cell(reach_km)))
    open_, last, every = rows.select("o", "lat", "lon", *_CELL), 0, []
    if known is not None:
        before = (F.col("stop_id").cast("long") - (1 << 40)).alias("ao")
        every.append(steps.keep(known.select(before, "anchor_lat", "anchor_lon", *sphere_cell(reach_km, "anchor_lat", "anchor_lon"), F.col("stop_id").cast("int").alias("stop_id"))))
        last = every[0].agg(F.max("stop_id")).first()[0] or 0
        near = _reached(every[0])
        open_ = steps.keep(open_.join(near, _within(open_, near, reach_km, distance), "left_anti"))
    found = _anchors(open_, reach_km, distance, measure or (ARC if distance is kilometres else None), steps)
    if found:
        new = reduce(DataFrame.unionByName, found)
        every.append(steps.keep(numbered(new, ["ao"], name="stop_id").withColumn("stop_id", (F.col("stop_id") + 1 + last).cast("int"))))
    if not every:
        return rows.limit(0).select(*stops.columns, F.lit(0.0).alias("anchor_lat"), F.lit(0.0).alias("anchor_lon"), F.lit(0).alias("stop_id"))
    near = _reached(reduce(DataFrame.unionByName, every), "stop_id")
    members = rows.join(near, _within(rows, near, reach_km, distance) & (F.col("o") >= F.col("ao")))
    if exclusive:
        nearest = Window.partitionBy("o").orderBy(distance("anchor_lat", "anchor_lon", "lat", "lon"), "ao")  # a few anchors
        members = members.withColumn("_n", F.row_number().over(nearest)).where("_n = 1")
    return members.select(*stops.columns, "anchor_lat", "anchor_lon", "stop_id")


def stop_tables(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stops, stop_props): a stop's place is the mean of its members'; properties are numbered by stop and order."""
    stops = members.groupBy(F.col("stop_id").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    counted = numbered(members, ["stop_id", "dateNum", "truckId", "cluster"], name="_n")
    props = counted.select(
        (F.col("_n") + 1).cast("int").alias("id"), F.col("stop_id").alias("stopPropId"), "truckId", "dateNum", "lat", "lon",
        clock.minutes_between("start", "stop").cast("double").alias("duration_min"),
        F.concat_ws(":", F.lpad(F.split("start", ":")[0], 2, "0"), F.lpad(F.split("start", ":")[1], 2, "0"), F.lit("00")).alias("time"),
        "radius",
    )
    return stops, props
