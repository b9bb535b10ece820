"""GPS tables projected from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import date_num, iso


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truck points: ten trucks that dwell near a place of their own, and wander where an event is an error."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    truck = F.col("user_id") % 10
    far = F.col("event_type") == "error"
    jitter = (F.col("event_id") % 3 - 1).cast("double") * 0.00002

    def moved(k: int) -> Column:
        return F.when(far, (F.col("event_id") % k).cast("double") * 0.0005).otherwise(jitter)

    shift = F.floor(F.hour("ts") / 6).cast("double")
    return e.select(
        F.concat(F.lit("DEV-"), truck.cast("string")).alias("truckId"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("value").alias("velocity"),
        (F.lit(-33.45) + truck.cast("double") * 0.01 + shift * 0.005 + moved(97)).alias("lat"),
        (F.lit(-70.65) + truck.cast("double") * 0.01 + moved(89)).alias("lon"),
        date_num("ts").alias("dateNum"),
        iso("ts").alias("timestamp"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor-like records with faults: latitudes of 91, speeds beyond the cap, headings of 400, times in two spellings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    return e.select(
        k.alias("seq"),
        F.when(k % 101 == 0, F.lit("  ")).otherwise(F.concat(F.lit("DEV-"), (F.col("user_id") % 10).cast("string"))).alias("device_id"),
        F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise((F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).cast("string")).alias("timestamp"),
        F.when(k % 50 == 0, F.lit(91.0)).otherwise(F.lit(-33.45) + (k % 100).cast("double") * 0.001).alias("lat"),
        F.when(k % 53 == 0, F.lit(-181.0)).otherwise(F.lit(-70.65) + (k % 70).cast("double") * 0.001).alias("lon"),
        F.when(k % 37 == 0, F.lit(450.0)).otherwise((k % 90).cast("double")).alias("speed_kph"),
        F.when(k % 41 == 0, F.lit(400.0)).otherwise((k % 360).cast("double")).alias("heading"),
        F.when(k % 43 == 0, F.lit(12.0)).when(k % 47 == 0, F.lit(-1.0)).otherwise((k % 5).cast("double")).alias("hdop"),
    )
