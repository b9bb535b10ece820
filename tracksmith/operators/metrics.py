"""Distance, time on road, speed and sampling frequency from consecutive points; counts and job statistics.

Points of a truck and day are taken in the order (ts, seq). All of a group's measures come from one window and one
aggregate, so the table is shuffled once whatever is asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.geo import Distance, kilometres, miles

BY = ("truckId", "dateNum")


def segments(points: DataFrame, by: Sequence[str] = BY, distance: Distance = kilometres) -> DataFrame:
    """Each point with `km` and `sec` from the point before it; null for the first."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    before = lambda c: F.lag(c).over(order)
    rows = points.select(*by, "ts", "seq", "time", "lat", "lon", before("lat").alias("lat0"), before("lon").alias("lon0"), before("time").alias("time0"))
    return rows.select(*by, "ts", "seq", "lat", "lon", distance("lat0", "lon0", "lat", "lon").alias("km"), (clock.seconds("time") - clock.seconds("time0")).alias("sec"))


def total_km() -> Column:
    return F.coalesce(F.sum("km"), F.lit(0.0))


def hours_on_road() -> Column:
    return F.coalesce(F.sum(F.when(F.col("km") > 0, F.col("sec"))), F.lit(0)) / 3600.0


def summary(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Distance, hours on road, km/h and seconds between points of every group."""
    made = segments(points, by).groupBy(*by).agg(F.count("*").alias("points"), total_km().alias("distance_km"), hours_on_road().alias("road_hours"), F.avg("sec").alias("frequency_s"))
    return made.withColumn("avg_kmh", F.try_divide("distance_km", "road_hours"))


def total_distance(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return segments(points, by).groupBy(*by).agg(total_km().alias("distance_km"))


def time_on_road(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Hours between points that differ in place."""
    return segments(points, by).groupBy(*by).agg(hours_on_road().alias("road_hours"))


def average_speed(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return summary(points, by).select(*by, "avg_kmh")


def gps_frequency(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean seconds between consecutive points; null for fewer than two."""
    return segments(points, by).groupBy(*by).agg(F.avg("sec").alias("frequency_s"))


def segment_speed(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Miles an hour between consecutive points; null at equal times."""
    rows = segments(points, by, miles).where(F.col("sec").isNotNull())
    return rows.select(*by, "seq", F.abs(F.try_divide(F.col("km"), F.col("sec") / 3600.0)).alias("mph"))


def truck_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("truckId").agg(F.count("*").alias("points"))


def zero_velocity(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return points.groupBy(*by).agg(F.count_if(F.col("velocity") == 0).alias("zeros"))


def date_of(points: DataFrame) -> DataFrame:
    """The first date behind each dateNum."""
    return points.groupBy("dateNum").agg(F.min(F.to_date("ts")).alias("date"))


def route_statistics(points: DataFrame, by: Sequence[str] = BY, sample_minutes: float = 0.5) -> DataFrame:
    """Kilometres, minutes at one point each half minute, km/h."""
    rows = segments(points, by).groupBy(*by).agg(total_km().alias("distance_km"), (F.count("*") * sample_minutes).alias("minutes"))
    return rows.withColumn("avg_kmh", F.try_divide(F.col("distance_km"), F.col("minutes") / 60.0))


def stop_distance(props: DataFrame, pairs: DataFrame) -> DataFrame:
    """Kilometres between the stop properties of each pair (a, b)."""
    one, two = props.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), props.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", kilometres("lat1", "lon1", "lat2", "lon2").alias("km"))


def count_by_ingest(points: DataFrame) -> DataFrame:
    return points.groupBy("ingest_id").agg(F.count("*").alias("points"))


def ingest_statistics(rows: DataFrame, by: str = "ingest_id") -> DataFrame:
    """read, accepted, rejected and status of each job, from rows with an error column."""
    made = rows.groupBy(by).agg(F.count("*").alias("read"), F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
    return made.withColumn("status", F.when(F.col("rejected") == 0, "succeeded").otherwise("partial"))


def job_status(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """Each job with the points stored for it."""
    return jobs.join(count_by_ingest(points), "ingest_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
