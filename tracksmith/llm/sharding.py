"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash of id and text within their source and ranked there; row r of n gets the fraction
(r - u) / n, where u is the source's own number in [0, 1), so that many small sources do not fall on the same places.
In the order of these fractions every stretch holds each source in proportion, so equal cuts of it give shards
that match the mixture and whose row counts differ by one at most.

No rank is taken over a whole source or table in one task: rows are ranked in buckets of the hash (then of the
fraction), and the buckets' counts, at most BUCKETS of them for a source, give where each bucket starts.

Defined cases: a null text has size 1 and the CRC of the empty text; a null source is a source of its own; null
ids and repeated rows are placed like others (rows equal in id, size and CRC may trade places); an empty table
gives no rows; other columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, power_of_two, unit, whole

#: Most buckets of a source, and rows that a bucket should hold while there are fewer.
BUCKETS, BUCKET_ROWS = 1 << 16, 256


def interleave(df: DataFrame, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 42, carry: bool = False) -> tuple[DataFrame, int]:
    """(id, size, crc, pos) of every row, pos 0.. in the interleaved order, and the number of rows; with carry, the row itself goes along as a struct."""
    n = df.count()
    buckets = min(BUCKETS, power_of_two(n / BUCKET_ROWS))
    rows = df.select(
        F.col(key).alias("id"),
        (F.octet_length(whole(text)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole(text), "UTF-8")).alias("crc"),
        F.when(F.col(stratum).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(stratum).cast("string"))).alias("stratum"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    ).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), "crc", "size"))).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("stratum", "bucket", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("stratum")).alias("of"))
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "id", "crc", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(starts, ["stratum", "bucket"])
    more = ["row"] if carry else []
    placed = ranked.select("id", "size", "crc", "stratum", "h", *more, ((F.col("start") + F.col("rank") - unit(seed, F.col("stratum"))) / F.col("of")).alias("part")).withColumn("bucket", F.floor(F.col("part") * buckets).cast("int"))
    totals = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    begins = totals.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))  # BUCKETS rows at most
    order = Window.partitionBy("bucket").orderBy("part", "stratum", "h", "id", "crc", "size")
    return placed.withColumn("rank", F.row_number().over(order)).join(begins, "bucket").select("id", "size", "crc", *more, (F.col("begin") + F.col("rank") - 1).alias("pos")), n


def cut(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Equal cuts of the order: shard, and slot within it."""
    found = placed.withColumn("shard", F.expr(f"CAST(pos * {shards} div {max(n, 1)} AS INT)"))
    return found.withColumn("slot", F.col("pos") - F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) div {shards}"))


def write_shards(df: DataFrame, path: str, shards: int = 8, files: int = 1, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 42) -> None:
    """The rows of df as Parquet below path/shard=K/, in about `files` files for each shard, in the order of their slots (column slot)."""
    placed, n = interleave(df, stratum, key, text, seed, carry=True)
    shard_, slot = fresh(df, "shard", "slot")
    rows = cut(placed, n, shards).select("row.*", F.col("shard").alias(shard_), F.col("slot").alias(slot))
    rows.repartitionByRange(shards * files, shard_, slot).sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)


def shard(df: DataFrame, shards: int = 8, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """key, size, text_crc32, law ('rows'), shard 0 to shards - 1, slot (gapless in a shard), grown_shard (null: the law gives none)."""
    placed, n = interleave(df, stratum, key, text, seed)
    return cut(placed, n, shards).select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

