"""Tables on parquet: append, overwrite, merge by key, job registry, blobs. A table that is read is never overwritten in place."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import INGEST_JOBS


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order`."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("_hash",), order: str = "seq_no", replace: bool = True) -> DataFrame:
    """stored with new merged in by key: new rows win, the one with the highest `order` among them; or only absent keys are added."""
    fresh = latest(new, keys, F.desc_nulls_last(order))
    if not replace:
        return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    return stored.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


#: Columns of stored rows: their part, when an upsert wrote them, and whether it only added absent keys.
_PART, _AT, _ADDED = "_part", "_at", "_added"


def _now() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class Tables(Protocol):
    """What ingest and plans ask of a storage: another one may take the Store's place."""

    spark: SparkSession

    def exists(self, name: str) -> bool: ...
    def read(self, name: str) -> DataFrame: ...
    def overwrite(self, name: str, df: DataFrame) -> None: ...
    def append(self, name: str, df: DataFrame) -> None: ...
    def upsert(self, name: str, df: DataFrame, keys: Sequence[str] = ("_hash",), order: str = "seq_no", replace: bool = True, part: Column | None = None) -> None: ...
    def truncate(self, name: str) -> None: ...
    def job_event(self, ingest_id: str, source: str, status: str, params: Mapping[str, str] | None = None, stats: tuple[int, int, int] | None = None, errors: Mapping[int, str] | None = None) -> None: ...


class Store:
    """Named tables below one folder, for any number of writers.

    A table is made of batches, folders of parquet files that are written aside and then renamed into it, each under
    a name of its own, so writers never meet: an append adds a batch. An upsert adds one as well, of rows that know
    when they came; which row of a key holds is decided when the table is read, and only in parts (days) that more
    than one batch has. compact() puts such parts together. An overwrite begins a new generation; those that it
    replaces stay readable until `keep` have been written. Writers on several machines are put in order by their
    clocks. Columns named in `told` get Bloom filters, by which lookups of a few values skip row groups; `options`
    go to the writer, such as parquet.block.size.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, told: Sequence[str] = ("_hash",), options: Mapping[str, str] | None = None) -> None:
        self.spark, self.root, self.keep, self.told, self.options = spark, root.rstrip("/"), keep, tuple(told), dict(options or {})

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        """What lies in a folder, but for hidden files."""
        fs, path = self._fs()
        found = fs.listStatus(path(folder)) if fs.exists(path(folder)) else []
        return sorted(n for f in found if not (n := f.getPath().getName()).startswith(("_", ".")))

    def _delete(self, folder: str) -> None:
        fs, path = self._fs()
        fs.delete(path(folder), True)

    def _add(self, name: str, generation: str, df: DataFrame, keys: Sequence[str] = (), part: Column | None = None, at: str | None = None) -> None:
        """Writes df aside and then renames it to a new batch of the generation."""
        fs, path = self._fs()
        aside, to = f"{self.root}/{name}/_staging/{uuid.uuid4().hex}", f"{self.root}/{name}/{generation}"
        marked = df.withColumn(_PART, F.coalesce(F.regexp_replace(part.cast("string"), "[^A-Za-z0-9-]", "-"), F.lit("none"))) if part is not None else df
        writer = marked.write.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in self.told}, **self.options)
        if part is None:
            writer.parquet(f"{aside}/{_PART}=all")
        else:
            writer.partitionBy(_PART).parquet(aside)
        fs.mkdirs(path(to))
        if not fs.rename(path(aside), path(f"{to}/{at or _now()}.{','.join(keys)}")):
            raise OSError(f"{aside} could not be moved to {to}")

    def _generation(self, name: str) -> str:
        return next(reversed(self._names(f"{self.root}/{name}")), f"{0:020d}")

    def _batches(self, name: str) -> dict[str, list[str]]:
        """Paths of the batches by part; a batch's folder is its time, and the keys of an upsert."""
        fs, path = self._fs()
        found: dict[str, list[str]] = {}
        for p in sorted(str(f.getPath()) for f in fs.globStatus(path(f"{self.root}/{name}/{self._generation(name)}/*/{_PART}=*"))):
            found.setdefault(p.rsplit("/", 1)[1], []).append(p)
        return found

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        """The rows of several batches; of each key the last one written, or else the first one added."""
        keys = sorted({p.split("/")[-2].split(".", 1)[1] for p in paths} - {""})
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        if not keys:
            return rows
        if len(keys) > 1:
            raise ValueError(f"a table has one key; found {keys}")
        added = F.coalesce(F.col(_ADDED), F.lit(False))
        return latest(rows, keys[0].split(","), added, F.when(added, F.col(_AT)), F.desc_nulls_last(_AT))

    def _fitted(self, name: str, df: DataFrame) -> DataFrame:
        """df with the types that the table's columns have already."""
        kinds = {f.name: f.dataType for f in self.read(name).schema} if self.exists(name) else {}
        return df.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in df.columns if kinds.get(c, df.schema[c].dataType) != df.schema[c].dataType})

    def exists(self, name: str) -> bool:
        return bool(self._batches(name))

    def version(self, name: str) -> str:
        """A name for the table's content as it is now; another write gives another."""
        return hashlib.sha256(json.dumps(self._batches(name)).encode()).hexdigest()[:16]

    def read(self, name: str) -> DataFrame:
        parts = self._batches(name)
        if not parts:
            raise ValueError(f"no table {name} in {self.root}")
        alone = [p for paths in parts.values() if len(paths) == 1 for p in paths]
        shared = [p for paths in parts.values() if len(paths) > 1 for p in paths]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*alone) if alone else None
        if shared:
            merged = self._merged(shared)
            rows = merged if rows is None else rows.unionByName(merged, allowMissingColumns=True)
        return rows.drop(_AT, _ADDED)

    def overwrite(self, name: str, df: DataFrame) -> None:
        self._add(name, _now(), df)
        for old in self._names(f"{self.root}/{name}")[: -self.keep]:
            self._delete(f"{self.root}/{name}/{old}")

    def append(self, name: str, df: DataFrame) -> None:
        self._add(name, self._generation(name), self._fitted(name, df))

    def save_items(self, name: str, df: DataFrame, delete: bool = False) -> None:
        (self.overwrite if delete else self.append)(name, df)

    def upsert(self, name: str, df: DataFrame, keys: Sequence[str] = ("_hash",), order: str = "seq_no", replace: bool = True, part: Column | None = None) -> None:
        """Merges df in by key; without `replace`, only absent keys are added. part: what rows with the same key always share, such as their day."""
        at = _now()
        self._add(name, self._generation(name), latest(self._fitted(name, df), keys, F.desc_nulls_last(order)).withColumns({_AT: F.lit(at), _ADDED: F.lit(not replace)}), keys, part, at)

    def compact(self, name: str) -> None:
        """Puts parts that several batches have into one batch. Writers may go on; a frame read before may miss its files and is then to be read anew."""
        now = self._generation(name)
        for part, paths in self._batches(name).items():
            keys = max(p.split("/")[-2].split(".", 1)[1] for p in paths)
            if len(paths) > 1 and keys:  # until the old ones are gone, rows are there twice, which a key bears
                self._add(name, now, self._merged(paths).withColumn(_PART, F.lit(part.split("=", 1)[1])), keys.split(","), F.col(_PART))
                for p in paths:
                    self._delete(p)

    def truncate(self, name: str) -> None:
        if self.exists(name):
            self.overwrite(name, self.read(name).limit(0))

    def names(self) -> list[str]:
        """The tables there are."""
        return self._names(self.root)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def purge(self) -> None:
        """Drops every table."""
        self._delete(self.root)

    def save_blob(self, name: str, value: DataFrame) -> None:
        self.overwrite(f"blob-{name}", value)

    def blob(self, name: str) -> DataFrame:
        return self.read(f"blob-{name}")

    # Jobs are events; the latest event of a job is its state.

    def job_event(self, ingest_id: str, source: str, status: str, params: Mapping[str, str] | None = None, stats: tuple[int, int, int] | None = None, errors: Mapping[int, str] | None = None) -> None:
        row = self.spark.createDataFrame([(ingest_id, source, dict(params or {}), status, None, None, stats, dict(errors or {}) or None)], INGEST_JOBS)
        now = F.current_timestamp()
        self.upsert("ingest_jobs", row.withColumn("started_at", now).withColumn("finished_at", F.when(F.col("status") != "running", now)).withColumn("event", F.lit(uuid.uuid4().hex)), ("event",), "event")

    def jobs(self) -> DataFrame:
        events = self.read("ingest_jobs")
        last = latest(events, ["ingest_id"], F.desc_nulls_last("finished_at"), F.desc("started_at"), F.desc("event"))
        begun = events.groupBy("ingest_id").agg(F.min("started_at").alias("started_at"), F.first(F.when(F.size("params") > 0, F.col("params")), True).alias("params"))
        return last.drop("event", "started_at", "params").join(begun, "ingest_id")

    def job(self, ingest_id: str) -> DataFrame:
        return self.jobs().where(F.col("ingest_id") == ingest_id)


def laid_out(points: DataFrame, device: str = "device_id", ts: str = "ts_utc") -> DataFrame:
    """Points as they should be written for lookups: by device, then time, in ranges, so that a file holds few devices and a busy one has many files."""
    return points.repartitionByRange(device, ts).sortWithinPartitions(device, ts)
