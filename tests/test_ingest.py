from __future__ import annotations

import concurrent.futures
import io
import json
import logging
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import SCHEMA, route, rows, single
from tracksmith.config import Settings
from tracksmith.functions import sql as sqlfn
from tracksmith.functions.checks import point_hash
from tracksmith.operators import lookups, stops
from tracksmith.operators.store import Store
from tracksmith.plans import ingest, logs, trucks
from tracksmith.sources import readers, synthetic
from tracksmith.sources.mapping import MappingPlan, inferred, plan_for
from tracksmith.streaming.ingest import file_stream, start_kafka, start_stream, stream_id
from tracksmith.streaming.stops import stream_stops

AS_OF = datetime(2024, 6, 1)

VAN = """device_id,ts_utc,latitude,longitude,speed_kph,heading_deg
VAN-7,2024-04-11T06:10:00Z,52.5201,13.4049,18,200
VAN-7,2024-04-11T06:10:20Z,52.5199,13.4046,21.6,205
VAN-7,2024-04-11T06:10:40Z,52.5196,13.4041,540,210
VAN-7,2024-04-11T06:11:00Z,52.5192,13.4037,25.2,
"""


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_a_file_with_a_spike(store, tmp_path):
    path = tmp_path / "van.csv"
    path.write_text(VAN)
    for job in ("a", "b"):
        ingest.ingest_file(store, str(path), ingest_id=job, as_of=AS_OF)
    got = store.read("track_points").orderBy("ts_utc").collect()
    assert [r.speed_mps for r in got] == pytest.approx([5.0, 6.0, None, 7.0], abs=1e-5)
    assert [r.quality_flags for r in got] == [None, None, {"flag_speed_spike": True}, None]
    assert {r.ingest_id for r in got} == {"b"}
    assert json.loads(got[2].raw)["meta"]["quality_flags"] == {"flag_speed_spike": True}
    assert got[0].loc.coordinates == [13.4049, 52.5201]
    job = store.job("a").first()
    assert (job.status, job.stats.read, job.stats.accepted, job.stats.rejected) == ("succeeded", 4, 4, 0)
    assert store.job("zzz").count() == 0


def test_json_kinds(spark, tmp_path, store):
    records = [{"device_id": "TRK-404", "timestamp": 1714568400 + 60 * i, "lat": 37.0, "lon": -122.0 + i, **({"speed_kph": 35.5} if i else {})} for i in range(3)]
    (tmp_path / "a.json").write_text("  " + json.dumps(records))
    (tmp_path / "b.ndjson").write_text("\n\n".join(map(json.dumps, records)))
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == readers.read_json(spark, str(tmp_path / "b.ndjson")).count() == 3
    ingest.ingest_file(store, str(tmp_path / "a.json"), as_of=AS_OF)
    assert sorted(r.speed_mps or 0 for r in store.read("track_points").collect()) == pytest.approx([0, 9.861111, 9.861111], abs=1e-5)
    with pytest.raises(ValueError):
        readers.kind_of("x.txt")
    assert readers.kind_of("/a/B.PARQUET") == "parquet"


def test_rejections_name_the_first_rule(store):
    ok = {"device_id": "D", "timestamp": "2024-05-01T12:00:00Z", "lat": 1.0, "lon": 2.0}
    bad = [{"lat": 91.0}, {"lon": 181.0}, {"timestamp": "invalid-date", "lat": 91.0}, {"device_id": " "}, {"timestamp": "2031-01-01T00:00:00Z"}]
    job = ingest.ingest_records(store, [ok, *({**ok, **b} for b in bad)], as_of=AS_OF)
    got = store.job(job).first()
    assert (got.status, got.stats.accepted, got.stats.rejected) == ("partial", 1, 5)
    assert set(got.error_sample) == {1, 2, 3, 4, 5}
    assert [got.error_sample[i][:20] for i in (1, 2, 3, 4)] == ["Latitude 91.0 out of", "Longitude 181.0 out ", "Cannot parse timesta", "device_id cannot be "]
    assert store.read("track_points").first().src == "generic"


@pytest.mark.parametrize(
    ("vendor", "record", "device", "speed"),
    [
        ("geotab", {"id": "G1", "dateTime": "2024-05-01T12:00:00Z", "latitude": 1.0, "longitude": 2.0, "speed": 45.0, "bearing": 10.0}, "G1", 12.5),
        ("samsara", {"deviceId": "S1", "timestamp": 1714568400000, "latitude": 1.0, "longitude": 2.0, "speedKph": 36.0}, "S1", 10.0),
        ("samsara", {"device": {"id": "S2"}, "timestamp": 1714568400000, "location": {"lat": 1.0, "lng": 2.0}, "vehicle": {"speedKph": 36.0}}, "S2", 10.0),
    ],
)
def test_vendors(spark, vendor, record, device, speed):
    df = readers.from_records(spark, record)
    got = ingest.normalized(df, plan_for(vendor, df.schema), "j", as_of=AS_OF).first()
    assert (got.device_id, got.error, got.src) == (device, None, vendor)
    assert got.speed_mps == pytest.approx(speed)
    assert json.loads(got.raw)["original"] == record


def test_mapping_defaults_and_flags(spark):
    df = spark.createDataFrame([("D", "1714568400", 1.0, 2.0, -1.0, "x"), ("D", "1714568400", 1.0, float("nan"), 12.0, "3")], "d string, t string, lat double, lon double, hdop double, v string")
    plan = MappingPlan({"d": "device_id", "t": "ts_utc", "lat": "lat", "lon": "lon", "hdop": "hdop"}, {}, {"alt_m": 7.0, "src": "given"}, "acme")
    one, two = ingest.normalized(df, plan, "j", as_of=AS_OF).collect()
    assert (one.alt_m, one.src, one.hdop, one.quality_flags) == (7.0, "acme", None, {"flag_bad_hdop": True})
    assert two.error == "Missing required field: lon"
    speedy = MappingPlan({**plan.field_map, "v": "speed_mps"}, {"speed_mps": "kph"})
    assert [r.error and r.error[:16] for r in ingest.normalized(df, speedy, "j", as_of=AS_OF).collect()] == ["Unexpected error", "Missing required"]
    assert inferred(["Device", "time", "speed_mph"], units=False).unit_map == {}


def test_hash(spark):
    c = point_hash(F.lit("TRK-TEST-001"), F.lit("2024-05-01 12:00:00").cast("timestamp"), F.lit(37.7749), F.lit(-122.4194))
    assert spark.range(1).select(c.alias("h")).first().h == "faa7d1f8755e3120205d374d5f1a003c13f99abb390ed27b606d6a2efaa5d8ef"


def test_sheets_by_name(tmp_path):
    sheet(tmp_path / "two.xlsx", [["first"]])
    with zipfile.ZipFile(tmp_path / "named.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="r9"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r2" Target="worksheets/one.xml"/><Relationship Id="r9" Target="/xl/worksheets/two.xml"/></Relationships>')
        for name, text in (("one", "b"), ("two", "a")):
            z.writestr(f"xl/worksheets/{name}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>')
    content = (tmp_path / "named.xlsx").read_bytes()
    assert [readers.sheet_rows(content, s) for s in (None, "A", "B")] == [[["a"]], [["a"]], [["b"]]]
    with pytest.raises(ValueError, match="no sheet 'C'"):
        readers.sheet_rows(content, "C")
    with pytest.raises(ValueError):
        readers.sheet_rows(b"\xd0\xcf\x11\xe0 old", None)


def sheet(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Hoja1" sheetId="1"/></sheets></workbook>')
        cell = lambda v, ref: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
        rows_ = "".join(f"<row>{''.join(cell(v, f'{chr(65 + j)}{i + 1}') for j, v in enumerate(r) if v is not None)}</row>" for i, r in enumerate(body))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows_}</sheetData></worksheet>')


def test_truck_sheets(spark, tmp_path):
    head = list(readers.TRUCK_SHEET)
    body = [head, ["A", "P", 41862, 0.5, -33.4, -70.6, "N", "C", 10, 1, 2], ["A", "P", "12-8-2014", 0.25, -33.4, None, "N", "C", 11, 1, 2]]
    sheet(tmp_path / "t.xlsx", body)
    sheet(tmp_path / "~t.xlsx", body)
    got = readers.read_truck_sheets(spark, f"{tmp_path}/*.xlsx").orderBy("seq").collect()
    assert [(r.truckId, r.timestamp, r.dateNum, r.lon) for r in got] == [("A", "2014-08-11T12:00:00", 259, -70.6), ("A", "2014-08-12T06:00:00", 260, None)]
    assert readers.read_truck_sheets(spark, f"{tmp_path}/t.xlsx", drop_last_row=True).count() == 1
    assert readers.read_any(spark, f"{tmp_path}/t.xlsx").columns == head


def test_job_and_computed(spark, store):
    store.save_items("truck_points", spark.createDataFrame(rows(route(3)), SCHEMA), delete=True)
    trucks.run(store)
    assert store.read("stops").count() == 3
    asked = trucks.Computed(store)
    asked.add("n", lambda c: c.store.read("stops").groupBy().count())
    assert asked.get("n").first()[0] == asked.get("n").first()[0] == 3
    store.truncate("stops")
    assert store.read("stops").count() == 0
    store.purge()
    assert not store.exists("stops")


def test_upsert_modes(spark, store):
    first = spark.createDataFrame([("a", 1, "j1"), ("b", 2, "j1")], "_hash string, seq_no long, ingest_id string")
    again = spark.createDataFrame([("b", 1, "j2"), ("b", 5, "j2"), ("c", 1, "j2")], "_hash string, seq_no long, ingest_id string")
    store.upsert("t", first)
    store.upsert("t", again)
    assert {(r._hash, r.seq_no, r.ingest_id) for r in store.read("t").collect()} == {("a", 1, "j1"), ("b", 5, "j2"), ("c", 1, "j2")}
    store.upsert("t", first.withColumn("seq_no", F.lit(9)), replace=False)
    assert store.read("t").where("seq_no = 9").count() == 0


def test_sql_functions(spark):
    sqlfn.register(spark)
    row = spark.sql("SELECT kil_dist(0, 0, 1, 0) AS km, date_num(timestamp '2024-06-30 00:00:00') AS n, clock_time('08:05:00') AS c, speed_to_mps(36, 'kph') AS v").first()
    assert (round(row.km, 6), row.n, row.c, row.v) == (111.229833, 216, "8:5", 10.0)


def test_rejected_rows_in_many_files(spark, store, tmp_path):
    for i in range(3):
        (tmp_path / "in.csv").mkdir(exist_ok=True)
        (tmp_path / "in.csv" / f"{i}.csv").write_text("device_id,ts_utc,latitude,longitude\n" + "".join(f"D{i},2024-05-01T12:0{k}:00Z,{91 if k == 1 else k},2\n" for k in range(3)))
    job = store.job(ingest.ingest_file(store, f"{tmp_path}/in.csv", as_of=AS_OF)).first()
    assert (job.status, job.stats.read, job.stats.accepted, job.stats.rejected) == ("partial", 9, 6, 3)
    assert sorted(job.error_sample) == [1, 4, 7]
    assert sorted(r.seq_no for r in store.read("track_points").collect()) == [0, 2, 3, 5, 6, 8]


def test_rows_are_numbered_where_they_stand(spark):
    frame = spark.range(0, 1000, 1, 7).where("id % 3 = 0 or id > 500")
    got = lookups.enumerated(frame, "n").orderBy("id").collect()
    assert [r.n for r in got] == list(range(len(got)))
    assert lookups.enumerated(frame.limit(0)).count() == 0


def test_versions_of_a_table(spark, store):
    one = spark.range(3).withColumn("day", F.lit("a"))
    store.overwrite("t", one)
    before = store.read("t")
    store.append("t", one)
    store.overwrite("t", one.limit(1))
    assert (before.count(), store.read("t").count()) == (3, 1)  # what was read stays readable for two more overwrites
    for _ in range(3):
        store.overwrite("t", one)
    assert len(store._names(f"{store.root}/t")) == 3
    fs, path = store._fs()
    fs.mkdirs(path(f"{store.root}/t/_staging/x/_part=all"))  # a writer that died
    assert store.read("t").count() == 3
    store.overwrite("t", one.limit(2))
    assert store.read("t").count() == 2
    store.truncate("t")
    assert store.read("t").count() == 0 and store.read("t").columns == ["id", "day"]
    store.save_blob("b", one)
    assert store.blob("b").count() == 3


def test_an_upsert_touches_its_days_only(spark, store):
    frame = lambda rows_: spark.createDataFrame(rows_, "_hash string, seq_no long, day string")
    store.upsert("p", frame([("a", 1, "2024-01-01"), ("b", 1, "2024-01-02"), ("c", 1, None)]), part=F.col("day"))
    kept = store._batches("p")["_part=2024-01-02"]
    store.upsert("p", frame([("a", 2, "2024-01-01"), ("d", 1, "2024-01-03"), ("c", 5, None)]), part=F.col("day"))
    assert store._batches("p")["_part=2024-01-02"] == kept
    store.upsert("p", frame([("b", 9, "2024-01-02"), ("e", 2, "2024-01-02")]), part=F.col("day"), replace=False)
    want = [("a", 2, "2024-01-01"), ("b", 1, "2024-01-02"), ("c", 5, None), ("d", 1, "2024-01-03"), ("e", 2, "2024-01-02")]
    told = lambda: sorted((r._hash, r.seq_no, r.day) for r in store.read("p").collect())
    assert told() == want
    store.compact("p")
    assert told() == want and all(len(x) == 1 for x in store._batches("p").values())
    store.upsert("p", frame([("b", 9, "2024-01-02")]), part=F.col("day"), replace=False)
    store.upsert("p", frame([("d", 7, "2024-01-03")]), part=F.col("day"))
    assert told() == [w if w[0] != "d" else ("d", 7, "2024-01-03") for w in want]
    assert store.read("p").columns == ["_hash", "seq_no", "day"]


def together(*work):
    """Runs the functions in threads of their own, and raises what one of them raised."""
    with concurrent.futures.ThreadPoolExecutor(len(work)) as pool:
        for f in [pool.submit(w) for w in work]:
            f.result()


def test_many_writers_lose_nothing(spark, store, tmp_path):
    other = Store(spark, store.root)
    frame = lambda w, k: spark.createDataFrame([(f"{w}-{k}", k, "x"), ("same", k, f"{w}")], "_hash string, seq_no long, who string")
    together(*[lambda w=w, s=s: [s.append("a", frame(w, k)) for k in range(3)] for w, s in enumerate((store, other, store, other))])
    assert store.read("a").count() == 4 * 3 * 2
    together(*[lambda w=w, s=s: [s.upsert("u", frame(w, k)) for k in range(3)] for w, s in enumerate((store, other, store, other))], lambda: [store.compact("u") for _ in range(2)])
    assert sorted(r._hash for r in store.read("u").collect()) == sorted([*(f"{w}-{k}" for w in range(4) for k in range(3)), "same"])
    together(*[lambda i=i: (store, other)[i % 2].job_event(f"j{i}", "s", "running") for i in range(8)])
    assert sorted(r.ingest_id for r in store.jobs().collect()) == [f"j{i}" for i in range(8)]
    store.compact("ingest_jobs")
    assert store.jobs().count() == 8


def test_a_result_notices_that_its_inputs_changed(spark, store):
    asked, made = trucks.Computed(store), []
    store.append("t", spark.range(3))
    asked.add("n", lambda c: made.append("n") or c.store.read("t").groupBy().count(), ("t",))
    asked.add("twice", lambda c: made.append("twice") or c.get("n").select((F.col("count") * 2).alias("count")), ("n",))
    assert (asked.get("twice").first()[0], asked.get("n").first()[0], made) == (6, 3, ["twice", "n"])
    assert trucks.Computed(store, asked.makers, asked.inputs).get("twice").first()[0] == 6 and len(made) == 2
    store.append("t", spark.range(2))
    assert (asked.get("twice").first()[0], made) == (10, ["twice", "n", "twice", "n"])
    asked.delete("n")
    assert asked.get("n").first()[0] == 5 and made[4:] == ["n"]
    with pytest.raises(KeyError):
        asked.get("x")


def test_file_stream(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"device_id": "D", "timestamp": "2024-05-01T12:00:00Z", "lat": 1.0, "lon": 2.0}
    late = {**line, "timestamp": "2024-04-20T12:00:00Z"}
    schema = T.StructType.fromDDL("device_id string, timestamp string, lat double, lon double")
    given = [[line, line, {**line, "lat": 2.0}], [line, {**line, "lat": 95.0}, late], [late]]
    for i, rows_ in enumerate(given):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join([*map(json.dumps, rows_), *(["{no json"] if i == 1 else [])]))
        q = start_stream(store, file_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/cp", source="files", once=True, as_of=AS_OF)
        q.awaitTermination()
    assert sorted((str(r.ts_utc), r.lat) for r in store.read("track_points").collect()) == [("2024-04-20 12:00:00", 1.0), ("2024-05-01 12:00:00", 1.0), ("2024-05-01 12:00:00", 2.0)]
    jobs = {r.ingest_id: (r.status, r.stats.read, r.stats.rejected) for r in store.jobs().collect()}
    own = stream_id(store, f"{tmp_path}/cp")
    assert jobs == {f"files-{own}-0": ("succeeded", 3, 0), f"files-{own}-1": ("partial", 4, 2), f"files-{own}-2": ("succeeded", 1, 0)}
    with pytest.warns(UserWarning):
        assert start_kafka(store, schema, "x", Settings()) is None


def test_log_lines(spark, store):
    out = io.StringIO()
    before = logging.getLogger().handlers[:]
    try:
        logs.set_up("info", stream=out)
        job = ingest.ingest_records(store, {"device_id": "D", "timestamp": "2024-05-01T12:00:00Z", "lat": 1.0, "lon": 2.0}, as_of=AS_OF)
        try:
            raise KeyError("gone")
        except KeyError:
            logging.getLogger("tracksmith.x").exception("bad")
    finally:
        logging.basicConfig(handlers=before or [logging.NullHandler()], force=True)
    done, bad = [json.loads(x) for x in out.getvalue().splitlines() if "tracksmith." in x]
    assert (done["logger"], done["ingest_id"], done["accepted"], done["rejected"], done["level"]) == ("tracksmith.ingest", job, 1, 0, "INFO")
    assert bad["level"] == "ERROR" and "KeyError" in bad["exception"]


def test_made_up_tracks(spark):
    way = synthetic.trace(spark, (1.0, 2.0), (2.0, 4.0), 5, noise=False).orderBy("i").collect()
    assert [(r.lat, r.lon) for r in way] == [(1 + k / 4, 2 + k / 2) for k in range(5)]
    still = synthetic.stop_points(spark, (10.0, 20.0), 10, seed=3)
    assert still.count() == 20
    assert all(abs(r.lat - 10) < 3e-4 and abs(r.lon - 20) < 3e-4 for r in still.collect())
    assert sorted(still.repartition(5).collect()) == sorted(synthetic.stop_points(spark, (10.0, 20.0), 10, seed=3).collect())
    stops_ = spark.createDataFrame([(t, s, 10 + s / 100, 20.0, 12 + s) for t in ("A", "B") for s in range(3)], "truckId string, stop int, lat double, lon double, minutes int")
    made = synthetic.delivery_route(stops_, seed=1).groupBy("truckId", "leg").count().collect()
    assert {(r.truckId, r.leg): r["count"] for r in made if r.leg % 2 == 0} == {(t, 2 * s): 24 + 2 * s for t in ("A", "B") for s in range(3)}
    assert all(10 <= r["count"] <= 25 for r in made if r.leg % 2) and len(made) == 10


def test_streamed_stops_equal_batch(spark, tmp_path):
    frame = spark.createDataFrame(rows(route(3)) + rows(single(15), "T2"), SCHEMA)
    late = spark.createDataFrame(rows([(datetime(2014, 8, 14), 0.0, 0.0, 0.0)], "T9"), SCHEMA)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_stops(source).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    for n in (2, 3):
        late.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {n} DAYS")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        q.processAllAvailable()
    q.stop()
    key = lambda r: (r.truckId, r.start, r.stop, r.points, round(r.radius, 9))
    want = {key(r) for r in stops.find_stops(frame).collect()}
    assert {key(r) for r in spark.table("streamed").collect()} == want
