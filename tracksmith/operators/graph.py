"""Connected components, adjacency, degrees and grid indexes over tables that the caller gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CELL_METRES
from ..functions.geo import cell


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (on a local master only) a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not known:
        known = f"file://{tempfile.mkdtemp(prefix='tracksmith-')}"
        remove_at_exit(spark, known)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    own = spark.sparkContext.getCheckpointDir()  # the application's own folder below it
    if own not in _REMOVED:
        _REMOVED.add(own)
        remove_at_exit(spark, own)
    return known


_REMOVED: set[str] = set()


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Frames may be read as long as the driver runs; then their files go."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder until the driver ends, so that a lost executor costs no recomputation.

    Sessions that run long let Spark remove the files of frames that are gone: spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop's rounds in the shared folder. Unlike a checkpoint, a table that is read again has its real size, so estimates do not multiply from round to round."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v), both long; the root is the component's smallest node.

    Nodes point at the smallest node they know of: in turn, larger neighbours and then smaller ones are moved to it.
    A join's sides are tables of their own, so that Spark can split a node with many neighbours.
    """
    rounds = Rounds(links.sparkSession)
    try:
        return saved(_rooted(links, most, rounds))
    finally:
        rounds.close()


def _rooted(links: DataFrame, most: int, rounds: Rounds) -> DataFrame:
    def least(pairs: DataFrame) -> DataFrame:
        return rounds.keep(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))

    now = rounds.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = rounds.keep(both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = least(large)
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rounds.keep(moved.unionByName(small.where("u <> m").select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"links still change after {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def adjacency(edges: DataFrame, edge: str = "edge", start: str = "start", end: str = "end") -> DataFrame:
    """node and the sorted edges that touch it at either end."""
    ends = edges.select(F.col(start).alias("node"), edge).unionByName(edges.select(F.col(end).alias("node"), edge))
    return ends.groupBy("node").agg(F.sort_array(F.collect_set(edge)).alias("edges"))


def max_out_degree(edges: DataFrame, start: str = "start") -> DataFrame:
    return edges.groupBy(start).count().agg(F.max("count").alias("max_out_degree"))


def grid_cells(points: DataFrame, metres: float = CELL_METRES, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with the row and column of their grid cell, counted from the smallest latitude and longitude."""
    low = points.agg(F.min(lat).alias("_lat"), F.min(lon).alias("_lon"))  # one row
    placed = points.crossJoin(F.broadcast(low))
    return placed.withColumn("cell_y", cell(lat, F.col("_lat"), metres)).withColumn("cell_x", cell(lon, F.col("_lon"), metres)).drop("_lat", "_lon")


def grid_index(points: DataFrame, key: str, metres: float = CELL_METRES) -> DataFrame:
    """Each occupied cell and the sorted keys in it."""
    return grid_cells(points, metres).groupBy("cell_y", "cell_x").agg(F.sort_array(F.collect_set(key)).alias("keys"))
