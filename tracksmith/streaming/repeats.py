"""Repeated and late messages, told on the stream before anything is stored.

A message is known by a key for a horizon after it was first seen; state keeps a count for each key and forgets it
then, by a timer on the time of arrival, so it is bounded by what a horizon brings. A repeat beyond it is told by
nobody here: the merge on the point's hash still stores it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import need_rocks

#: Names that begin with an underscore do not reach a stateful processor.
REPEAT, LATE, KEY, ARRIVED = "is_repeat", "is_late", "message_key", "arrived"


class FirstSeen(StatefulProcessor):
    def __init__(self, horizon_ms: int) -> None:
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n long, first long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first = self.seen.get() if self.seen.exists() else (0, 0)
        arrived = None  # all rows of a batch came at one time
        for batch in rows:
            if batch.empty:
                continue
            if arrived is None:
                arrived = int(batch[ARRIVED].iloc[0].timestamp() * 1000)
                if n and arrived - first > self.horizon_ms:
                    self.handle.deleteTimer(first + self.horizon_ms)
                    n = 0
                first = first if n else arrived
            yield batch.drop(columns=[KEY, ARRIVED], errors="ignore").assign(**{REPEAT: [n + i > 0 for i in range(len(batch))]})
            n += len(batch)
        if arrived is not None:
            self.handle.registerTimer(first + self.horizon_ms)  # the horizon runs from the first one
            self.seen.update((n, first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def told_apart(messages: DataFrame, horizon_seconds: float, key: Column | None = None, time: Column | None = None) -> DataFrame:
    """messages with is_repeat (one with the same key came within the horizon) and is_late (its time lies more than the horizon back).

    Without a key, a message is known by all of its columns.
    """
    need_rocks(messages.sparkSession)
    late = F.lit(False) if time is None else F.coalesce(F.current_timestamp() > time + F.make_dt_interval(secs=F.lit(float(horizon_seconds))), F.lit(False))
    known = F.sha2(F.to_json(F.struct(*messages.columns)), 256) if key is None else key.cast("string")
    rows = messages.select(F.coalesce(known, F.lit("")).alias(KEY), F.current_timestamp().alias(ARRIVED), late.alias(LATE), "*").withWatermark(ARRIVED, "0 seconds")
    schema = T.StructType([*[f for f in rows.schema if f.name not in (KEY, ARRIVED)], T.StructField(REPEAT, T.BooleanType())])
    return rows.groupBy(KEY).transformWithStateInPandas(FirstSeen(int(horizon_seconds * 1000)), schema, "append", "EventTime")
