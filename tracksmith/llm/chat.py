"""Chat formatting with DataFrame functions only: logged snapshots collapse before conversations are rendered.

Logs often hold a conversation again and again as it grows. Each prefix of a conversation's turns has a rolling
hash: the exclusive or of hashes of (place, role, text), 128 bits in all, so a window sum gives every prefix.
Equal hashes of prefixes of the same length are taken for equal prefixes; among 10**12 prefixes the chance that
any two others share theirs is below 10**-14.
A conversation whose whole hash is a proper prefix of another one is dropped by an anti-join; of equal ones the
smallest id stays. What is left is rendered in the ChatML form.

A conversation becomes one row, so its turns meet in one task; groups of equal or prefix-sharing conversations,
however large, are counted before the join and never meet.

Defined cases: turns without a conversation id take no part; rows equal in id, turn, role and text count once;
turns are ordered by turn (nulls first), then role and text; a null role is "unknown", a null text empty; template
marks inside a text are broken up; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The template's marks.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def turns_of(df: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turns, a, b): the rolling hash of the first `place` turns of each conversation."""
    once = turns.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # the order in which turns are rendered
    placed = once.withColumn("place", F.row_number().over(order)).withColumn("turns", F.count("*").over(Window.partitionBy("conv_id")))
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(rolling)
    return placed.select("conv_id", "place", "turns", mark("a").alias("a"), mark("b").alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, copies) of conversations that no longer one begins with; of equal ones the smallest id."""
    rows = saved(prefixes(turns))
    whole = rows.where("place = turns").groupBy("turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = rows.where("place < turns").select(F.col("place").alias("turns"), "a", "b").distinct()
    return whole.join(proper, ["turns", "a", "b"], "left_anti").select("conv_id", "turns", "copies")


def rendered(role: Column, text: Column) -> Column:
    safe = F.replace(F.replace(text, F.lit("<|im_"), F.lit("< |im_")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), safe, F.lit(f"{END}\n"))


def format_chats(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, n_assistant, rendered: one row for each maximal conversation."""
    turns = turns_of(df)
    left = maximal(turns)
    rows = turns.join(left, "conv_id").select("conv_id", "turns", "copies", F.struct("turn", "role", "text").alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.first("turns").alias("n_turns"), F.first("copies").alias("n_copies"), F.array_sort(F.collect_set("t")).alias("all"))
    return grouped.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        "n_copies",
        F.size(F.filter("all", lambda t: t["role"] == "assistant")).cast("long").alias("n_assistant"),
        F.array_join(F.transform("all", lambda t: rendered(t["role"], t["text"])), "").alias("rendered"),
    )
