from __future__ import annotations

import json
import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import SCHEMA, km
from tracksmith.config import Settings
from tracksmith.operators import metrics, stops
from tracksmith.operators.store import Store
from tracksmith.sources import spool
from tracksmith.streaming import repeats, summary
from tracksmith.streaming.ingest import start_mqtt
from tracksmith.streaming.stops import Open, hull

AS_OF = datetime(2024, 6, 1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_a_hull_has_the_farthest_two_points():
    rng = random.Random(3)
    for at, to in ((-33.0, -70.6), (89.99995, 10.0), (0.0, 179.99995)):
        for n in (1, 2, 3, 10, 300):
            places = [(min(90.0, at + rng.gauss(0, 1e-4)), to + rng.gauss(0, 1e-4)) for _ in range(n)]
            places += places[: n // 3] + [places[0]] * 5
            lats, lons = hull([p[0] for p in places], [p[1] for p in places])
            far = max(km(a, b) for a in places for b in places)
            assert max(km(a, b) for a in zip(lats, lons, strict=True) for b in zip(lats, lons, strict=True)) == pytest.approx(far, abs=1e-9)
            assert len(lats) <= n and set(zip(lats, lons, strict=True)) <= set(places)


def test_a_parked_truck_keeps_small_state():
    """A day of a point a second: linear time, and what is kept is the hull."""
    rng, now, began = np.random.default_rng(1), Open(), time.perf_counter()
    lats, lons = -33.0 + rng.uniform(-4e-5, 4e-5, 86_400), -70.6 + rng.uniform(-4e-5, 4e-5, 86_400)
    for i in range(0, 86_400, 7200):
        for j in range(i, i + 7200):
            assert not now.n or now.reaches(lats[j], lons[j], 0.02)
            now.take(float(lats[j]), float(lons[j]), j, 86_400_000)
        now = Open(now.values())
    assert time.perf_counter() - began < 20
    assert len(now.lats) < 100
    (row,) = now.stop("T", 1, 10)
    assert row[2] == pytest.approx(sum(lats.tolist()) / 86_400, abs=1e-12) and row[7] == 86_400
    assert row[4] == pytest.approx(stops.diameter(lats, lons) / 2, abs=1e-9)


def files(spark, frame, folder, cuts):
    """The frame's rows in order, as one file for each slice between the cuts."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 1 << 60], strict=True)):
        frame.where((F.col("i") >= a) & (F.col("i") < b)).drop("i").coalesce(1).write.parquet(f"{folder}/{i}")
        yield


def test_streamed_sums_equal_batch_sums(spark, store, tmp_path):
    rng = random.Random(2)
    found = []
    for truck in ("A", "B"):
        at = datetime(2014, 8, 11, 20)
        for _ in range(120):
            at += timedelta(seconds=rng.randint(0, 300))
            found.append((truck, at.strftime("%H:%M:%S"), 1.0, rng.choice([1.0, 1.001, None, 1.002]), 2.0, at.month * 31 + at.day, at.isoformat(), at, len(found)))
    frame = spark.createDataFrame([(*r, i % 120) for i, r in enumerate(found)], f"{SCHEMA}, i long")
    late = frame.where("i in (30, 31) and truckId = 'A'").withColumn("i", F.lit(200))
    stream = frame.where("i not in (30, 31) or truckId = 'B'").unionByName(late)
    source = spark.readStream.schema(frame.drop("i").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in files(spark, stream, f"{tmp_path}/in", [40, 90, 150]):
        q = summary.start_summary(store, source, f"{tmp_path}/cp", once=True)  # a restart for each batch
        q.awaitTermination()
    key = lambda r: (r.truckId, r.dateNum, r.points, *(None if v is None else round(v, 9) for v in (r.distance_km, r.road_hours, r.frequency_s, r.avg_kmh)))
    in_time = metrics.summary(stream.where("i < 200"))
    assert sorted(map(key, summary.told(store.read("day_sums")).collect()), key=str) == sorted(map(key, in_time.collect()), key=str)
    assert sorted(r.seq for r in store.read("late_points").collect()) == sorted(r.seq for r in late.collect())
    whole = summary.repaired(store.read("day_sums"), store.read("late_points"), frame)
    assert sorted(map(key, whole.collect()), key=str) == sorted(map(key, metrics.summary(frame).collect()), key=str)


def test_repeats_and_late_messages_are_told(spark, tmp_path):
    schema = "device string, at timestamp"
    now, began = datetime.utcnow(), time.time()
    make = lambda n, made: spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    make(0, [("a", now), ("a", now), ("b", now - timedelta(days=2)), (None, None)])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []

    def run():
        """One restart that takes what there is; time runs on between two of them."""
        told = repeats.told_apart(source, 20.0, time=F.col("at"))
        write = lambda batch, n: got.extend((r.device, r[repeats.REPEAT], r[repeats.LATE]) for r in batch.collect())
        assert told.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert sorted(got, key=str) == sorted([("a", False, False), ("a", True, False), ("b", False, True), (None, False, False)], key=str)
    make(1, [("a", now), ("c", datetime.utcnow())])
    run()
    assert ("a", True, False) in got[4:] or time.time() - began > 20
    time.sleep(22)
    for n in (2, 3):  # the first one moves the clock on
        make(n, [("a", now)])
        run()
    assert ("a", False, True) in got[6:]  # beyond the horizon it counts as new, and is late


def test_topics():
    taken = lambda f, t: bool(spool.topic_pattern(f).fullmatch(t))
    assert taken("devices/+/gps", "devices/7/gps") and not taken("devices/+/gps", "devices/7/8/gps") and not taken("devices/+/gps", "devices/7/gps/x")
    assert taken("a/#", "a") and taken("a/#", "a/b/c") and taken("#", "x/y") and taken("p/q, a.b", "a.b") and not taken("a.b", "axb")


def put(folder, n, messages, topic="devices/7/gps"):
    body = "".join(m if isinstance(m, str) and m.endswith("\n") else json.dumps({"topic": topic, "payload": m}) + "\n" for m in messages)
    (folder / f"{n:06d}.part").write_text(body)
    os.rename(folder / f"{n:06d}.part", folder / f"{n:06d}.jsonl")


def test_a_spool_loses_and_doubles_nothing_over_a_kill(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    sent, got, fail = [], [], [True]

    def write(batch, number):
        found = [r.payload for r in batch.collect()]
        if "m1-0" in found and fail[0]:
            fail[0] = False
            raise RuntimeError("killed")  # after the offsets were planned, before the batch was done
        got.extend(found)

    def start():
        return spool.spool_stream(spark, str(folder), "devices/+/gps", files=2).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").start()

    def add(k):
        put(folder, k, [f"m{k}-{i}" for i in range(3)])
        sent.extend(f"m{k}-{i}" for i in range(3))

    add(0)
    q = start()
    q.processAllAvailable()
    add(1)
    put(folder, 3, ["other"], topic="devices/7/battery")
    for _ in range(600):
        if not q.isActive:
            break
        time.sleep(0.1)
    assert "killed" in str(q.exception()), (got, q.lastProgress)
    q.stop()
    for k in (4, 5):
        put(folder, k, [f"m{k}", "no json\n"])
        sent += [f"m{k}", "no json"]
    for k in (None, 7, None, 8):
        if k:
            put(folder, k, [f"m{k}"])
            sent.append(f"m{k}")
        q = start()
        q.processAllAvailable()
        q.stop()
    assert sorted(got) == sorted(sent)
    assert len(list(folder.glob("*.jsonl"))) <= 2  # what is committed goes


def test_a_spool_is_read_file_by_file(tmp_path):
    reader = spool.SpoolReader({"path": str(tmp_path), "files": "2"})
    assert reader.initialOffset() == {"after": ""} == reader.latestOffset()
    for k in range(5):
        put(tmp_path, k, [f"m{k}"])
    ends = [reader.latestOffset() for _ in range(4)]
    assert [e["after"][:6] for e in ends] == ["000001", "000003", "000004", "000004"]
    names = lambda a, b: sorted(n for p in reader.partitions(a, b) for n in p.names)
    assert names(ends[0], ends[1]) == ["000002.jsonl", "000003.jsonl"] and names(ends[2], ends[3]) == []
    reader.commit(ends[2])
    assert reader.names() == [] and spool.SpoolReader({"path": str(tmp_path)}).latestOffset() == ends[2]  # a restart goes on from there
    with pytest.raises(ValueError, match="mount"):
        spool.SpoolReader({"path": "s3://x/y"})


def test_mqtt_messages_are_ingested_once(spark, store, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    schema = T.StructType.fromDDL("device_id string, timestamp string, lat double, lon double")
    point = lambda i: {"device_id": f"D{i}", "timestamp": "2024-05-01T12:00:00Z", "lat": 1.0, "lon": 2.0}
    with pytest.warns(UserWarning, match="disabled"):
        assert start_mqtt(store, str(folder), schema, f"{tmp_path}/cp", Settings()) is None
    put(folder, 1, [point(1), point(2), point(2), "broken\n"])
    q = start_mqtt(store, str(folder), schema, f"{tmp_path}/cp", Settings(mqtt_enabled=True, trigger="1 second"), horizon_seconds=3600)
    try:
        for n, more in ((1, [point(2), point(3)]), (2, None)):
            for _ in range(300):
                if store.exists("ingest_jobs") and store.jobs().where("status <> 'running'").count() >= n:
                    break
                time.sleep(0.3)
            if more:
                put(folder, 2, more)
    finally:
        q.stop()
    assert sorted(r.device_id for r in store.read("track_points").collect()) == ["D1", "D2", "D3"]
    jobs = sorted(((r.stats.read, r.stats.rejected, r.params["repeats"]) for r in store.jobs().collect()), key=str)
    assert jobs == [(1, 0, "1"), (3, 1, "1")]
