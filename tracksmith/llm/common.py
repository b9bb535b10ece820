"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Rounds, saved, shared_dir

__all__ = ["Rounds", "fresh", "named", "power_of_two", "saved", "shared_dir", "slices", "table", "unit", "whole"]

#: ASCII white space, as a class for Java and RE2 expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near those given that clash with none of df's, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def power_of_two(n: float) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def whole(text: Column | str) -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


#: A key that more than one of so many rows has goes by broadcast in named().
HEAVY = 1000


def named(rows: DataFrame, names: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with names, which has one row for each key and in `count` how many of the `total` rows have it.

    No task gets all rows of a hot key: the names of keys that more than total / HEAVY rows have, HEAVY at most, are
    broadcast; only other keys are shuffled.
    """
    hot = F.broadcast(names.where(F.col(count) * HEAVY > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(names.where(F.col(count) * HEAVY <= total), key)
    return rows.join(hot, key).unionByName(rest)


def slices(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 (null: empty), in runs of about `most` bytes and one text at least, with each run's start."""
    run, start, size, i = [], 0, 0, -1
    for i, text in enumerate(texts):
        b = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(b) > most:
            yield start, run
            run, start, size = [], i, 0
        run.append(b)
        size += len(b)
    if run:
        yield start, run


def unit(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
