"""Stops of a truck and day, schedules, popular stops, long dwells and depots, time windows, nearest places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEPOT_HOURS
from ..functions.geo import Distance, around, inside, kilometres, sphere_cell
from .graph import saved
from .lookups import given


def _with_stop(props: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop properties with the stop they belong to (stop_id, stop_lat, stop_lon)."""
    parent = stops.select(F.col("id").alias("stop_id"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
    return props.join(parent, F.col("stopPropId") == F.col("stop_id"))


def stops_of(props: DataFrame, stops: DataFrame, truck: str | None = None, date_num: int | None = None) -> DataFrame:
    """Each truck's stops by day (or over all days, without one), with the first property at each."""
    rows = _with_stop(given(props, truckId=truck, dateNum=date_num), stops)
    first = Window.partitionBy("truckId", *(["dateNum"] if date_num is not None or truck is None else []), "stop_id").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def parent_stop(props: DataFrame, stops: DataFrame) -> DataFrame:
    """Every property's stop."""
    return _with_stop(props, stops).select("id", "stop_id", "stop_lat", "stop_lon")


def stop_statistics(props: DataFrame, stops: DataFrame, truck: str | None = None, date_num: int | None = None) -> DataFrame:
    return _with_stop(given(props, truckId=truck, dateNum=date_num), stops)


def popular_stops(props: DataFrame, stops: DataFrame, least: int = 1, lists: bool = True) -> DataFrame:
    """Stops with at least so many properties, the first of these, and (with lists: a stop's must fit a task) all."""
    every = [F.sort_array(F.collect_list("id")).alias("props")] if lists else []
    rows = _with_stop(props, stops).groupBy("stop_id", "stop_lat", "stop_lon").agg(F.count("*").alias("n"), F.min("id").alias("first_prop"), *every)
    return rows.where(F.col("n") >= least)


def schedule(props: DataFrame, stops: DataFrame, truck: str | None = None, date_num: int | None = None) -> DataFrame:
    """Each truck's day: time, place and minutes in order of time; of two at the same time the last stays."""
    rows = stops_of(props, stops, truck, date_num)
    last = Window.partitionBy("truckId", "dateNum", "time").orderBy(F.desc("id"))
    kept = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return kept.select("truckId", "dateNum", "time", "lat", "lon", "duration_min").orderBy("truckId", "dateNum", "time")


def long_dwells(props: DataFrame, hours: float, within: Column | None = None, strict: bool = False) -> DataFrame:
    """Properties that last longer than so many hours. Not strict: a stop's rows count from its first one within the fence on, as the rows after it are not tested."""
    rows = props.where(F.col("duration_min") / 60.0 > hours).withColumn("_in", inside() if within is None else within)
    if strict:
        return rows.where("_in").drop("_in")
    so_far = Window.partitionBy("stopPropId").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_seen", F.max("_in").over(so_far)).where("_seen").drop("_in", "_seen")


def depots(props: DataFrame, within: Column | None = None, strict: bool = False) -> DataFrame:
    """Long dwells of the depot finder."""
    return long_dwells(props, DEPOT_HOURS, within, strict)


def time_windows(props: DataFrame, below_hours: float = 4.0, whole_hours: bool = False, lists: bool = True) -> DataFrame:
    """Properties shorter than so many hours, by their length in hours, exact or rounded down: their number, the first, and (with lists: a window's must fit a task) all."""
    hours = F.col("duration_min") / 60.0
    key = F.floor(hours).cast("double") if whole_hours else hours
    rows = props.where(hours < below_hours).withColumn("hours", key)
    every = [F.sort_array(F.collect_list(F.struct("id", "stopPropId", "truckId", "dateNum", "lat", "lon", "time"))).alias("props")] if lists else []
    return rows.groupBy("hours").agg(F.count("*").alias("n"), F.min("id").alias("first_prop"), *every)


def pair_distances(points: DataFrame, by: str, key: str, distance: Distance = kilometres) -> DataFrame:
    """The distance of every ordered pair of rows within a group: its size is the answer's, so groups should be small."""
    a = points.select(by, F.col(key).alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(by, F.col(key).alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, by).where("a <> b").select(by, "a", "b", distance("lat1", "lon1", "lat2", "lon2").alias("km"))


def nearest_address(rows: DataFrame, places: DataFrame, most_km: float = 1.0) -> DataFrame:
    """rows with the address of the nearest of places (lat, lon, address) within most_km: a join on grid cells, no service."""
    asked = saved(rows.drop("address").withColumn("_row", F.monotonically_increasing_id()))
    known = places.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "address").select("*", *sphere_cell(most_km, "_lat", "_lon"))
    cells = around(asked.select("_row", "lat", "lon", *sphere_cell(most_km)))
    found = cells.join(known, ["x", "y", "z"]).withColumn("_km", kilometres("lat", "lon", "_lat", "_lon")).where(F.col("_km") <= most_km)
    best = found.groupBy("_row").agg(F.min_by("address", F.struct("_km", "address")).alias("address"))
    return asked.join(best, "_row", "left").drop("_row")
