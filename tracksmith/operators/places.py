"""Tables in the order of place, so that scans for a place skip what lies elsewhere, and the nearest places without a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Distance, kilometres
from .graph import saved

#: Levels of cells; each cuts a cell's sides in four, so the last ones are 12 m wide.
_LEVELS = 10
#: A level with at most so many cells is sent to the tasks; a cell with at most so many places is not cut further.
_SENT, _FEW = 20_000, 32
#: What rounding can make of distances, as an angle: an arc cosine near 1 tells no more.
_SLACK = 2e-7


def _woven(axes: Sequence[str], bits: int) -> Column:
    """One whole number from several, by taking a bit of each in turn: the place on a space-filling curve."""
    taken = [F.shiftleft(F.shiftright(a, b).bitwiseAND(F.lit(1)), b * len(axes) + i) for i, a in enumerate(axes) for b in range(bits)]
    while len(taken) > 1:  # a shallow tree
        taken = [x.bitwiseOR(y) for x, y in zip(taken[::2], taken[1::2], strict=False)] + (taken[-1:] if len(taken) % 2 else [])
    return taken[0]


def _steps(share: Column, bits: int) -> Column:
    """A share from 0 to 1 as a whole number of so many bits."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0**bits - 1), F.floor(share * 2.0**bits))).cast("long")


def by_place(points: DataFrame, lat: str = "lat", lon: str = "lon", then: Sequence[str] = ()) -> DataFrame:
    """Points as they should be written for near() and boxes: along a space-filling curve, in ranges, so that the least and largest latitude and longitude of a row group lie close together.

    `then` orders points of one place, and lets a place that holds many of them go to several files. Null places come first.
    """
    axes = points.withColumns({"_py": _steps((F.col(lat) + 90.0) / 180.0, 20), "_px": _steps((F.col(lon) + 180.0) / 360.0, 20)})
    keyed = axes.withColumn("_place", _woven(["_py", "_px"], 20)).drop("_py", "_px")
    return keyed.repartitionByRange("_place", *then).sortWithinPartitions("_place", *then).drop("_place")


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """df's rows that have a place, with the place on the unit sphere: _x, _y, _z."""
    p, q = F.radians(lat), F.radians(lon)
    placed = df.withColumns({"_x": F.cos(p) * F.cos(q), "_y": F.cos(p) * F.sin(q), "_z": F.sin(p)})
    return placed.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y") & ~F.isnan("_z"))


def nearest(rows: DataFrame, places: DataFrame, k: int = 1, key: str = "address", into: str = "nearest", distance: Distance = kilometres) -> DataFrame:
    """rows with an array of their k nearest places (key, km), however far they are; equal distances go by key.

    Both tables have lat and lon. Places lie in a tree of cells with their number and bounds. All asked positions go
    down the tree together, one join a level: of the cells met, those stay that may hold one of the k nearest, as the
    number of places in nearer cells tells. So no position meets more than its neighbourhood, however many places
    share a cell, and rows at one position are asked once. Rows without a place, and an empty table of places, get an
    empty array; there are fewer than k entries where there are fewer places; a column named as `into` is replaced.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    same = Window.partitionBy("_lat", "_lon").orderBy("_key")  # of places at one point the first k are enough
    known = places.select(F.col(key).alias("_key"), F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    known = _on_sphere(known, "_lat", "_lon").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    axes = {f"_c{a}": _steps((F.col(f"_{a}") + 1.0) / 2.0, 2 * _LEVELS) for a in "xyz"}
    known = saved(known.withColumns(axes).withColumn("_cell", _woven(list(axes), 2 * _LEVELS)).drop("_n", *axes))

    def bounds(lows: Sequence[str], highs: Sequence[str], n: Column) -> list[Column]:
        return [n.alias("_n"), *[F.min(c).alias(f"{a}0") for a, c in zip("xyz", lows, strict=True)], *[F.max(c).alias(f"{a}1") for a, c in zip("xyz", highs, strict=True)]]

    cells = known.groupBy("_cell").agg(*bounds(["_x", "_y", "_z"], ["_x", "_y", "_z"], F.count("*")))
    level = F.explode(F.array(*[F.struct(F.lit(v).alias("_level"), F.shiftright("_cell", 6 * (_LEVELS - v)).alias("_at")) for v in range(1, _LEVELS + 1)]))
    tree = cells.select("*", level.alias("_l")).groupBy("_l._level", "_l._at").agg(*bounds(["x0", "y0", "z0"], ["x1", "y1", "z1"], F.sum("_n")))
    tree = saved(tree.repartition("_level", "_at"))
    sizes = {r["_level"]: r for r in tree.groupBy("_level").agg(F.count("*").alias("cells"), F.max("_n").alias("most")).collect()}  # a row for each level
    if not sizes:
        return rows.withColumn(into, F.array().cast(f"array<struct<{key}:{places.schema[key].dataType.simpleString()},km:double>>"))
    leaf = next((v for v in sorted(sizes) if sizes[v]["most"] <= _FEW), _LEVELS)
    used = [v for v in range(1, leaf + 1) if v == leaf or sizes[v]["cells"] != (sizes[v - 1]["cells"] if v > 1 else 1)]  # a level that cuts nothing is left out

    at = Window.partitionBy("_alat", "_alon")
    asked = rows.select(F.col("lat").cast("double").alias("_alat"), F.col("lon").cast("double").alias("_alon")).distinct()
    front, above = _on_sphere(asked, "_alat", "_alon").withColumn("_cell", F.lit(0).cast("long")), 0
    for v in used:
        below = tree.where(F.col("_level") == v).drop("_level").withColumn("_cell", F.shiftright("_at", 6 * (v - above)))
        met = front.join(F.broadcast(below) if sizes[v]["cells"] <= _SENT else below, "_cell")
        off = {a: (F.col(f"{a}0") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"{a}1")) for a in "xyz"}
        least = sum((F.pow(F.greatest(F.lit(0.0), *d), F.lit(2.0)) for d in off.values()), F.lit(0.0))
        most = sum((F.pow(F.greatest(F.abs(d[0]), F.abs(d[1])), F.lit(2.0)) for d in off.values()), F.lit(0.0))
        met = met.withColumns({"_least": F.sqrt(least), "_most": F.sqrt(most)}).select("_alat", "_alon", "_x", "_y", "_z", "_at", "_n", "_least", "_most")
        so_far = F.sum("_n").over(at.orderBy("_most", "_at").rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_so_far", so_far).withColumn("_reach", F.min(F.when(F.col("_so_far") >= k, F.col("_most"))).over(at))
        kept = met.where(F.col("_reach").isNull() | (F.col("_least") <= F.col("_reach") + _SLACK))
        front, above = kept.select("_alat", "_alon", "_x", "_y", "_z", F.col("_at").alias("_cell")), v

    near = front.select("_alat", "_alon", "_cell").join(known.select("_key", "_lat", "_lon", F.shiftright("_cell", 6 * (_LEVELS - leaf)).alias("_cell")), "_cell")
    near = near.withColumn("_km", distance("_alat", "_alon", "_lat", "_lon")).withColumn("_rank", F.row_number().over(at.orderBy("_km", "_key"))).where(F.col("_rank") <= k)
    found = near.groupBy("_alat", "_alon").agg(F.sort_array(F.collect_list(F.struct("_rank", "_key", "_km"))).alias("_found"))
    entries = F.transform("_found", lambda e: F.struct(e["_key"].alias(key), e["_km"].alias("km")))
    own = rows.drop(into).withColumns({"_alat": F.col("lat").cast("double"), "_alon": F.col("lon").cast("double")})
    joined = own.join(found.select("_alat", "_alon", entries.alias(into)), ["_alat", "_alon"], "left").drop("_alat", "_alon")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(joined.schema[into].dataType)))
