"""Filters, lookups, distinct values, extremes, sampling and paging over any of the tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ERROR_SAMPLE, SAMPLE_EVERY
from .graph import saved


def matching(df: DataFrame, **equal: object) -> DataFrame:
    """Rows where every named column equals its value; None matches null."""
    for name, value in equal.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def given(df: DataFrame, **equal: object) -> DataFrame:
    """As matching(), but arguments that are None are left out."""
    return matching(df, **{k: v for k, v in equal.items() if v is not None})


def first_matching(df: DataFrame, **equal: object) -> DataFrame:
    return matching(df, **equal).limit(1)


def by_id(df: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row for each id: the last in `order`."""
    latest = Window.partitionBy(key).orderBy(F.desc(order or key))
    return df.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def truck_points(points: DataFrame, truck: str | None = None, date_num: int | None = None) -> DataFrame:
    return given(points, truckId=truck, dateNum=date_num)


def points_of_day(points: DataFrame, date_num: int, trucks: Sequence[str] | None = None) -> DataFrame:
    """truckId and its points of the day, as an array in order of time."""
    rows = points.where(F.col("dateNum") == date_num)
    rows = rows.where(F.col("truckId").isin(list(trucks))) if trucks else rows
    return rows.groupBy("truckId").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "lat", "lon"))).alias("points"))


def device_range(points: DataFrame, device: str, start: datetime | str, end: datetime | str, key: str = "device_id", ts: str = "ts_utc") -> DataFrame:
    """A device's points from start to end, both included, in order of time."""
    bound = lambda v: F.lit(v).cast("timestamp")
    return points.where((F.col(key) == device) & F.col(ts).between(bound(start), bound(end))).orderBy(ts)


def existing(candidates: DataFrame, stored: DataFrame, key: str = "_hash") -> DataFrame:
    """Candidates whose key is stored already."""
    return candidates.join(stored.select(key), key, "left_semi")


def existing_few(candidates: DataFrame, stored: DataFrame, key: str = "_hash", most: int = 1000) -> DataFrame:
    """As existing(). Up to `most` distinct keys are looked for in the stored table first, so that its scan can skip row groups by their bounds and Bloom filters; more are joined."""
    asked = [r[0] for r in candidates.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    if len(asked) > most:
        return existing(candidates, stored, key)
    found = stored.select(key).where(F.col(key).isin(asked))
    return candidates.join(F.broadcast(found.distinct()), key, "left_semi")  # at most `most` rows


def sampled(points: DataFrame, every: int = SAMPLE_EVERY, by: Sequence[str] = ("truckId", "dateNum")) -> DataFrame:
    """The first and then every n-th point of each group, in order of time."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    return points.withColumn("_n", F.row_number().over(order)).where(F.col("_n") % every == 1 if every > 1 else F.lit(True)).drop("_n")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def extreme(df: DataFrame, column: str, largest: bool = True) -> DataFrame:
    """The largest or smallest value; null for an empty table."""
    return df.agg((F.max if largest else F.min)(column).alias(column))


def extents(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def error_sample(df: DataFrame, error: Column | str, index: str, most: int = ERROR_SAMPLE) -> DataFrame:
    """The first `most` errors by row index, as a map."""
    said = F.col(error) if isinstance(error, str) else error
    first = df.where(said.isNotNull()).select(F.col(index).cast("long").alias("key"), said.alias("value")).orderBy("key").limit(most)
    return first.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("errors"))


def enumerated(df: DataFrame, name: str = "seq_no") -> DataFrame:
    """Rows numbered from 0 without gaps, in the order in which they are read; rows stay where they are."""
    kept = saved(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    begins = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(begins), F.lit(0)).alias("_start"))  # a row for each partition
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def numbered(df: DataFrame, order: Sequence[str], chunk: int | None = None, name: str = "seq_no") -> DataFrame:
    """Rows numbered from 0 over the whole table in `order`; with a chunk, numbers begin anew after so many rows.

    Each range-sorted partition is counted, and numbered from where those before it end, so no task holds the table.
    """
    parts = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    begins = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(begins), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at") - F.col("_first")
    return parts.join(F.broadcast(starts), "_part").withColumn(name, place % chunk if chunk else place).drop("_part", "_at", "_first", "_start")
