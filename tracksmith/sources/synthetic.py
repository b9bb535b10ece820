"""Made-up tracks: straight legs, dwells and whole routes with noise, the same for the same seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The noise of moving and of standing points, in degrees, and the points of a leg between two stops.
MOVING, STANDING = 0.00005, 0.00003
LEG_POINTS = (10, 25)


def legs(plan: DataFrame, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Points along each row of plan (leg, lat, lon, lat2, lon2, points, noise, and `by`): evenly from one end to the other, with Gaussian noise.

    The noise of a point depends on seed and place only, not on partitions: two hashes of it give one normal number.
    """
    each = plan.where("points > 0").select("*", F.posexplode(F.sequence(F.lit(1), F.col("points"))).alias("i", "_at"))
    part = F.col("i") / F.greatest(F.col("points") - 1, F.lit(1))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *by, "leg", "i"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    spread = F.sqrt(F.lit(-2.0) * F.ln(uniform(0))) * F.col("noise")
    turn = uniform(1) * 6.283185307179586
    at = lambda a, b, f: (F.col(a) + (F.col(b) - F.col(a)) * part + spread * f(turn)).alias(a)
    return each.select(*by, "leg", "i", at("lat", "lat2", F.cos), at("lon", "lon2", F.sin))


_PLAN = "leg int, lat double, lon double, lat2 double, lon2 double, points int, noise double"


def trace(spark: SparkSession, start: tuple[float, float], end: tuple[float, float], points: int = 20, noise: bool = True, seed: int = 0) -> DataFrame:
    """i, lat, lon: points on the way from start to end."""
    return legs(spark.createDataFrame([(0, *start, *end, points, MOVING if noise else 0.0)], _PLAN), seed).drop("leg")


def stop_points(spark: SparkSession, place: tuple[float, float], minutes: float = 15, every_seconds: float = 30, seed: int = 0) -> DataFrame:
    """i, lat, lon: points of a vehicle that stands at a place."""
    return legs(spark.createDataFrame([(0, *place, *place, int(minutes * 60 / every_seconds), STANDING)], _PLAN), seed).drop("leg")


def delivery_route(stops: DataFrame, every_seconds: float = 30, seed: int = 0, by: Sequence[str] = ("truckId",)) -> DataFrame:
    """by, leg, i, lat, lon: each truck's dwells (stops: by, stop, lat, lon, minutes) in the order of `stop`, and the ways between them."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("stop")
    after = stops.select(*by, "stop", "lat", "lon", "minutes", F.lead("lat").over(order).alias("lat2"), F.lead("lon").over(order).alias("lon2"))
    stand = after.select(*by, (F.col("stop") * 2).alias("leg"), "lat", "lon", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.floor(F.col("minutes") * 60 / every_seconds).cast("int").alias("points"), F.lit(STANDING).alias("noise"))
    few, many = LEG_POINTS
    drawn = (F.lit(few) + F.pmod(F.xxhash64(F.lit(seed), *by, "stop"), F.lit(many - few + 1))).cast("int")
    drive = after.where("lat2 is not null").select(*by, (F.col("stop") * 2 + 1).alias("leg"), "lat", "lon", "lat2", "lon2", drawn.alias("points"), F.lit(MOVING).alias("noise"))
    return legs(stand.unionByName(drive), seed, by)
