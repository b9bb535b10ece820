"""Rows for CSV exports of stops, stop properties and truck days, and the unquoted line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import inside
from .dwell import stops_of


def line(*columns: Column | str) -> Column:
    """The values with commas between and a line end; nothing is quoted. Without values, an empty text."""
    return F.concat(F.concat_ws(",", *columns), F.lit("\n")) if columns else F.lit("")


def _address(df: DataFrame) -> Column:
    return F.col("address") if "address" in df.columns else F.lit(None).cast("string")


def stops_export(stops: DataFrame) -> DataFrame:
    return stops.select("id", "lat", F.col("lon").alias("lng"), _address(stops).alias("address"))


def stop_props_export(props: DataFrame, dates: DataFrame, date_num: int, within: Column | None = None) -> DataFrame:
    """The day's properties within the fence; time is the date of dateNum (dates: dateNum, date) with the stop's clock."""
    rows = props.where((F.col("dateNum") == date_num) & (inside() if within is None else within)).join(F.broadcast(dates.where(F.col("dateNum") == date_num)), "dateNum")
    time = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T"), F.col("time"))
    return rows.select("id", "lat", F.col("lon").alias("lng"), F.col("duration_min").cast("string").alias("duration"), time.alias("time"), F.col("truckId").alias("truckid"), _address(props).alias("address"))


def truck_day_export(props: DataFrame, stops: DataFrame, truck: str, date_num: int, within: Column | None = None) -> DataFrame:
    """A truck's day; its times carry the date 1900-01-01, as a clock alone has none."""
    rows = stops_of(props, stops, truck, date_num).where(inside() if within is None else within)
    time = F.concat(F.lit("1900-01-01T"), F.col("time"))
    return rows.select(F.col("truckId").alias("truckid"), F.col("dateNum").alias("datenum"), "lat", F.col("lon").alias("lng"), _address(props).alias("address"), time.alias("time"), F.col("duration_min").cast("string").alias("duration"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
