"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary finds the digests that many rows share. Their exact sizes and winners are counted with a
map-side join against at most `counters` candidates, and broadcast, so that hot groups never meet in one task.
Only the other digests, each held by at most rows / counters rows, go through an ordinary shuffle.

Defined cases: a null text counts as empty; empty and all-space texts form groups like any other; of rows that
share a text the smallest id stays, null ids come last, and of rows with the same text and id exactly one stays;
an empty table gives an empty result; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, saved, whole

#: Most counters of a summary, and so most digests that are ever broadcast.
COUNTERS = 512


def text_digest(text: Column | str) -> Column:
    """Hex SHA-256 of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(whole(text), f"{SPACE}+", " "), 256)


def summary(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """At most k counters: beyond that, all fall by the (k+1)th largest, so each count is short by rows / (k+1) at most."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, estimate) of k digests at most, among them every one held by more than 1 / (k+1) of the rows."""
    name = digests.columns[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for d, c in batch.iloc[:, 0].value_counts().items():
                counts[bytes(d)] = counts.get(bytes(d), 0) + int(c)
            counts = summary(counts, k)
        yield pd.DataFrame({"digest": list(counts), "estimate": list(counts.values())})

    merged = digests.select(F.col(name).alias("digest")).mapInPandas(count, "digest binary, estimate long")
    return merged.groupBy("digest").agg(F.sum("estimate").alias("estimate")).orderBy(F.desc("estimate"), "digest").limit(k)


def winners(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, winner, size) of the frequent digests that really repeat; rows: digest, winner's order as a struct."""
    candidates = F.broadcast(frequent(rows.select("digest"), k).select("digest"))  # k rows at most
    counted = rows.join(candidates, "digest").groupBy("digest").agg(F.min("place").alias("winner"), F.count("*").alias("size"))
    return counted.where("size > 1")


def duplicate_groups(df: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256."""
    ids = df.select(F.col(key).alias("id"), F.unhex(text_digest(text)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row").alias("place")
    rows = saved(ids).select("digest", place)
    heavy = F.broadcast(saved(winners(rows, counters)))  # counters rows at most
    hot = rows.join(heavy, "digest").select("digest", "place", "winner", "size")
    light = rows.join(heavy, "digest", "left_anti")
    # Counted before the shuffle and joined: a group is streamed, not held, and Spark may split it.
    rest = light.join(light.groupBy("digest").agg(F.min("place").alias("winner"), F.count("*").alias("size")), "digest").select("digest", "place", "winner", "size")
    return hot.unionByName(rest).select(F.col("place.id").alias(key), F.col("winner.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """df without the rows whose text a row with a smaller id has; all columns as they are."""
    digest, winner, size, rank = fresh(df, "digest__", "winner__", "size__", "rank__")
    rows = df.select(F.unhex(text_digest(text)).alias("digest"), F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id")).alias("place"))
    heavy = saved(winners(saved(rows), counters)).select(F.col("digest").alias(digest), F.col("winner").alias(winner))
    # Hot groups lose their rows before the shuffle; the winner goes on, and with it rows of the same id.
    marked = df.withColumn(digest, F.unhex(text_digest(text))).join(F.broadcast(heavy), digest, "left")
    left = marked.where(F.col(winner).isNull() | F.col(f"{winner}.id").eqNullSafe(F.col(key)))
    order = Window.partitionBy(digest).orderBy(F.col(key).asc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
