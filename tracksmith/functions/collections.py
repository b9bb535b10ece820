"""Maps and arrays: lookups with defaults, multimaps, maps from rows, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def get_or(map_: Column | str, key: object, default: Column | object) -> Column:
    return F.coalesce(F.try_element_at(_col(map_), key if isinstance(key, Column) else F.lit(key)), default if isinstance(default, Column) else F.lit(default))


def multimap(df: DataFrame, key: str, value: str, name: str = "values") -> DataFrame:
    """Each key's values; their order is sorted, so that it does not depend on partitions."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def map_of(key: Column | str, value: Column | str) -> Column:
    """An aggregate: the map from key to value, sorted by key."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(_col(key).alias("key"), _col(value).alias("value")))))


def not_empty(value: Column | str) -> Column:
    return F.coalesce(F.size(_col(value)) > 0, F.lit(False))


def canonical_json(map_: Column | str) -> Column:
    """JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(map_)))))
