"""Normalizing, validating and storing track points: one select of expressions, then a split by its error column."""

from __future__ import annotations

import logging
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, clock
from ..functions.geo import geojson
from ..operators.lookups import enumerated, error_sample
from ..operators.store import Tables
from ..sources import readers
from ..sources.mapping import MappingPlan, field_names, inferred, mapped, plan_for

_RAW = "_original"
LOG = logging.getLogger("tracksmith.ingest")


class FileIngestionError(Exception):
    """A file could not be read or stored; its job is marked as failed."""


def normalized(df: DataFrame, plan: MappingPlan, ingest_id: str = "", seq: str | None = None, as_of: datetime | Column | None = None, hidden: str | None = None) -> DataFrame:
    """Canonical track points with `error`: null, or the first rule that the row breaks.

    Order of the rules: required fields, time, its range, coordinates; then speed, heading and HDOP, which only flag.
    `seq` names a column with the row's number; without it, numbers follow the order of the rows as read, with gaps
    from partition to partition. `hidden` names a column that is no part of the record.
    """
    c = mapped(df, plan)
    lat, lon, device = checks.number(c["lat"]), checks.number(c["lon"]), c["device_id"].cast("string")
    given = {n: checks.number(c[n]) for n in ("speed_mps", "heading_deg", "alt_m", "hdop")}
    source = {t: s for s, t in plan.field_map.items() if s in field_names(df.schema)}
    broken = [F.when(F.col(f"`{source[n]}`" if source[n] in df.columns else source[n]).isNotNull() & c[n].try_cast("double").isNull(), f"Unexpected error: {source[n]} is not a number") for n in ("speed_mps", "alt_m") if n in source]
    ts, raw_ts = clock.repaired(c["ts_utc"]), c["ts_utc"].cast("string")
    rows = df.select(
        F.to_json(F.struct(*[F.col(f"`{x}`") for x in df.columns if x != hidden])).alias(_RAW),
        (F.col(seq) if seq else F.monotonically_increasing_id()).alias("seq_no"),
        device.alias("device_id"), ts.alias("ts_utc"), raw_ts.alias("_ts"), lat.alias("lat"), lon.alias("lon"),
        *[v.alias(n) for n, v in given.items()], c["src"].cast("string").alias("src"),
        F.coalesce(*broken, F.lit(None).cast("string")).alias("_broken"),
    )
    col = F.col

    def rule(r: Column) -> Column:
        return F.coalesce(
            r["_broken"],
            checks.required(device_id=r["device_id"], ts_utc=r["_ts"], lat=r["lat"], lon=r["lon"]),
            F.when(r["ts_utc"].isNull(), F.concat(F.lit("Cannot parse timestamp: "), r["_ts"])),
            checks.time(r["ts_utc"], as_of),
            checks.coordinates(r["lat"], r["lon"]),
        )

    # Through one array element: a filter on the error then goes down to the scan with each input written once, not once for every use.
    error = F.get(F.transform(F.array(F.struct("_broken", "device_id", "_ts", "ts_utc", "lat", "lon")), rule), 0)
    (speed, spike), (heading, turned), (hdop, vague) = checks.speed(col("speed_mps")), checks.heading(col("heading_deg")), checks.hdop(col("hdop"))
    raised = checks.flags(flag_speed_spike=spike, flag_bad_heading=turned, flag_bad_hdop=vague)
    raw = F.when(raised.isNull(), F.concat(F.lit('{"original":'), col(_RAW), F.lit("}"))).otherwise(F.concat(F.lit('{"original":'), col(_RAW), F.lit(',"meta":{"quality_flags":'), F.to_json(raised), F.lit("}}")))
    return rows.select(
        "device_id", "ts_utc", "lat", "lon", speed.alias("speed_mps"), heading.alias("heading_deg"), "alt_m", hdop.alias("hdop"), "src", raw.alias("raw"),
        F.lit(ingest_id).alias("ingest_id"), "seq_no", raised.alias("quality_flags"), geojson().alias("loc"),
        checks.point_hash("device_id", "ts_utc", "lat", "lon").alias("_hash"), error.alias("error"),
    )


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted points, rejected rows)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def result(rows: DataFrame, ingest_id: str) -> DataFrame:
    """One row: accepted, rejected, errors by row number (the first ten), ingest_id."""
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
    return counts.crossJoin(error_sample(rows, "error", "seq_no")).withColumn("ingest_id", F.lit(ingest_id))  # one row each


def ingest(store: Tables, df: DataFrame, plan: MappingPlan, source: str, ingest_id: str | None = None, params: dict[str, str] | None = None, as_of: datetime | None = None, seq: str | None = None) -> str:
    """Normalizes df into the table track_points and records the job; returns its id."""
    job = ingest_id or str(uuid.uuid4())
    store.job_event(job, source, "running", params)
    rows = None
    try:
        own = None if seq else "_seq_no"
        rows = normalized(df if seq else enumerated(df, own), plan, job, seq or own, as_of, own).persist()
        accepted, _ = split(rows)
        found = result(rows, job).first()
        if found.accepted:
            store.upsert("track_points", accepted, part=F.to_date("ts_utc"))  # a hash holds the time, so rows with the same one share their day
        status = "succeeded" if not found.rejected else "partial"
        store.job_event(job, source, status, None, (found.accepted + found.rejected, found.accepted, found.rejected), found.errors)
        LOG.info("ingest %s", status, extra={"ingest_id": job, "source": source, "batch_size": found.accepted + found.rejected, "accepted": found.accepted, "rejected": found.rejected})
    except Exception as e:
        store.job_event(job, source, "failed", None, None, {0: str(e)[:500]})
        raise FileIngestionError(str(e)) from e
    finally:
        if rows is not None:
            rows.unpersist()
    return job


def ingest_file(store: Tables, path: str, vendor: str | None = None, plan: MappingPlan | None = None, ingest_id: str | None = None, as_of: datetime | None = None, units: bool = True) -> str:
    """Reads a CSV, JSON, Excel or Parquet path and ingests it; the mapping is given, the vendor's, or told by the names."""
    spark = store.spark
    try:
        df = readers.read_any(spark, path)
    except Exception as e:
        job = ingest_id or str(uuid.uuid4())
        store.job_event(job, "file", "failed", {"path": path}, None, {0: str(e)[:500]})
        raise FileIngestionError(str(e)) from e
    use = plan or (plan_for(vendor, df.schema) if vendor else inferred(field_names(df.schema), "file", units))
    return ingest(store, df, use, "file", ingest_id, {"path": path, "vendor": use.vendor}, as_of)


def ingest_records(store: Tables, records: list[dict] | dict, vendor: str = "generic", ingest_id: str | None = None, as_of: datetime | None = None) -> str:
    """What a webhook does with its body."""
    df = readers.from_records(store.spark, records)
    return ingest(store, df, plan_for(vendor, df.schema), "webhook", ingest_id, {"vendor": vendor}, as_of)
