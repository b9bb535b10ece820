"""Which truck has points on which day, and the centre of each truck's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.collections import map_of
from ..functions.geo import point


def availability(points: DataFrame) -> DataFrame:
    """dateNum, truckId, available for every date and every truck that occurs; one aggregate feeds both lists."""
    there = points.groupBy("dateNum", "truckId").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    days, trucks = there.select("dateNum").distinct(), there.select("truckId").distinct()
    # Every day with every truck is the result itself: its size is the answer's, not a blow-up.
    grid = days.crossJoin(trucks)
    return grid.join(there, ["dateNum", "truckId"], "left").select("dateNum", "truckId", F.col("lat").isNotNull().alias("available"), "lat", "lon")


def route_centers(points: DataFrame) -> DataFrame:
    """The mean place of each truck and day; null without points."""
    return availability(points).select("dateNum", "truckId", "lat", "lon")


def truck_dates(points: DataFrame) -> DataFrame:
    """One row a day, with maps from truck to availability and to centre."""
    rows = availability(points).withColumn("center", F.when(F.col("available"), point()))
    return rows.groupBy("dateNum").agg(map_of("truckId", "available").alias("availability"), map_of("truckId", "center").alias("routeCenters"))


def availability_report(points: DataFrame, trucks: list[str] | None = None) -> DataFrame:
    """One row a day, one column a truck."""
    pivoted = availability(points).groupBy("dateNum")
    return (pivoted.pivot("truckId", trucks) if trucks else pivoted.pivot("truckId")).agg(F.first("available"))
