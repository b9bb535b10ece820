"""Streams of JSON messages into the store: micro-batches, one job for each batch.

A batch is written by an idempotent merge on the points' hash and then recorded by Spark's checkpoint, so at-least-once
delivery stores every point once, however late a message or its repeat comes. With a horizon, repeats within it are
told on the stream and left out, and the batch's job counts them and the late messages. Messages that break a rule,
or are no JSON, are counted and sampled in the batch's job and stop nothing. No more batches than
`Settings.jobs_at_once` are ingested at a time, over all streams of a driver.
"""

from __future__ import annotations

import json
import threading
import warnings
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.store import Tables
from ..plans.ingest import ingest
from ..sources.mapping import MappingPlan, field_names, plan_for
from ..sources.spool import spool_stream
from .repeats import LATE, REPEAT, told_apart

#: A slot for each batch that may be ingested at once, by how many there are.
_SLOTS: dict[int, threading.BoundedSemaphore] = {}
_LOCK = threading.Lock()


def slots(settings: Settings) -> threading.BoundedSemaphore:
    with _LOCK:
        return _SLOTS.setdefault(settings.jobs_at_once, threading.BoundedSemaphore(settings.jobs_at_once))


def parsed(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Messages' JSON as columns; what does not parse has nulls, and is rejected later with a message."""
    return messages.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")


def stream_id(store: Tables, checkpoint: str) -> str:
    """The query's own id, which its checkpoint keeps over restarts."""
    return json.loads(store.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def start_stream(store: Tables, rows: DataFrame, checkpoint: str, vendor: str = "generic", plan: MappingPlan | None = None, source: str = "stream", settings: Settings = Settings(), once: bool = False, as_of: datetime | None = None, horizon_seconds: float | None = None, time: Column | None = None) -> StreamingQuery:
    """Ingests the stream batch by batch; a batch's job is named after the source, the query's id and the batch.

    Streams of one session share its cores by `settings.pool`, a pool of Spark's fair scheduler, and take at most
    `settings.files_at_once` files or `batch_size` messages a batch. With `horizon_seconds`, whole messages that came
    before within it are left out; `time`, the messages' own time, tells which of them are late.
    """
    use = plan or plan_for(vendor, rows.schema)

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        job = f"{source}-{stream_id(store, checkpoint)}-{number}"
        params = {"batch": str(number), "fields": ",".join(field_names(rows.schema))}
        with slots(settings):
            if horizon_seconds is None:
                ingest(store, batch, use, source, job, params, as_of)
                return
            told = batch.persist()
            try:
                repeats, late = told.agg(F.count_if(REPEAT), F.count_if(~F.col(REPEAT) & F.col(LATE))).first()
                ingest(store, told.where(~F.col(REPEAT)).drop(REPEAT, LATE), use, source, job, params | {"repeats": str(repeats), "late": str(late)}, as_of)
            finally:
                told.unpersist()

    context = store.spark.sparkContext
    before = context.getLocalProperty("spark.scheduler.pool")
    context.setLocalProperty("spark.scheduler.pool", settings.pool)  # the stream's thread takes it over
    try:
        writer = (rows if horizon_seconds is None else told_apart(rows, horizon_seconds, time=time)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=settings.trigger)).start()
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """JSON files as they come; a line that is no JSON gives a row of nulls, which ingest rejects and counts."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(path)


def start_kafka(store: Tables, schema: T.StructType, checkpoint: str, settings: Settings) -> StreamingQuery | None:
    """A topic's messages; None with a warning where Kafka is off. Needs Spark's Kafka connector on the class path."""
    if not settings.kafka_enabled:
        warnings.warn("Kafka ingestion is disabled", stacklevel=2)
        return None
    options = {"kafka.bootstrap.servers": settings.kafka_servers, "subscribe": settings.kafka_topic, "maxOffsetsPerTrigger": str(settings.batch_size)}
    messages = store.spark.readStream.format("kafka").options(**options).load()
    return start_stream(store, parsed(messages, schema), checkpoint, source="kafka", settings=settings)


def start_mqtt(store: Tables, spool: str, schema: T.StructType, checkpoint: str, settings: Settings, horizon_seconds: float | None = None) -> StreamingQuery | None:
    """Messages of `settings.mqtt_topic` that a broker's bridge spools (sources.spool); nothing is dropped when batches lag."""
    if not settings.mqtt_enabled:
        warnings.warn("MQTT ingestion is disabled", stacklevel=2)
        return None
    messages = spool_stream(store.spark, spool, settings.mqtt_topic, settings.files_at_once)
    return start_stream(store, parsed(messages, schema, "payload"), checkpoint, source="mqtt", settings=settings, horizon_seconds=horizon_seconds)
