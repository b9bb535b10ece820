from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import SCHEMA, model_stops, route, rows, single
from tracksmith.functions import clock, units
from tracksmith.functions.geo import inside, kilometres, miles, near
from tracksmith.operators import dwell, export, fleet, graph, lookups, metrics, stops
from tracksmith.operators.store import laid_out


def points(spark, given, truck="T1"):
    return spark.createDataFrame(rows(given, truck), SCHEMA)


@pytest.mark.parametrize(("given", "km_total", "hours", "speed", "frequency"), [(route(2), 1.531002, 0.470833, 3.251685, 47.083333), (route(3), 3.022165, 0.791667, 3.817471, 47.5), (single(15), 0.056828, 0.25, 0.227314, 60.0), (single(8), 0.028415, 0.133333, 0.213113, 60.0)])
def test_metrics(spark, given, km_total, hours, speed, frequency):
    got = metrics.summary(points(spark, given)).first()
    assert got.distance_km == pytest.approx(km_total, abs=2e-5)
    assert got.road_hours == pytest.approx(hours, abs=1e-6)
    assert got.avg_kmh == pytest.approx(speed, rel=1e-3)
    assert got.frequency_s == pytest.approx(frequency, abs=1e-6)


def test_metrics_of_one_point_and_none(spark):
    got = metrics.summary(points(spark, single(0))).first()
    assert (got.distance_km, got.road_hours, got.frequency_s, got.avg_kmh) == (0.0, 0.0, None, None)
    assert metrics.summary(points(spark, [])).count() == 0


def test_equal_places_take_no_time(spark):
    t = datetime(2024, 1, 1)
    got = metrics.summary(points(spark, [(t, 1.0, 1.0, 0.0), (t + timedelta(minutes=5), 1.0, 1.0, 0.0)])).first()
    assert (got.distance_km, got.road_hours, got.avg_kmh) == (0.0, 0.0, None)


@pytest.mark.parametrize(("given", "want"), [(route(3), [15, 18, 20]), (single(15), [16]), (single(10), [11]), (single(8), []), ([], []), (single(0), [])])
def test_stop_sizes(spark, given, want):
    assert [r.points for r in stops.find_stops(points(spark, given)).orderBy("cluster").collect()] == want


def test_stop_details(spark):
    got = stops.find_stops(points(spark, route(3))).orderBy("cluster").collect()
    assert [(r.start, r.stop, r.minutes) for r in got] == [("8:0", "8:10", 10.0), ("8:15", "8:28", 13.0), ("8:33", "8:47", 14.0)]
    assert [r.radius for r in got] == pytest.approx([0.002841, 0.00284, 0.00284], abs=1e-5)
    assert got[1].lat == pytest.approx(37.451899, abs=1e-6)


def test_stops_match_a_plain_model(spark):
    rng, given = random.Random(3), {}
    for truck in range(6):
        t, lat, lon, out = datetime(2024, 3, 1, 0, 0), 10.0, 20.0, []
        for _ in range(300):
            t += timedelta(seconds=rng.randint(20, 200))
            if rng.random() < 0.08:
                lat, lon = lat + rng.uniform(-1e-3, 1e-3), lon + rng.uniform(-1e-3, 1e-3)
            out.append((t, lat + rng.gauss(0, 5e-5), lon + rng.gauss(0, 5e-5), 0.0))
        given[f"T{truck}"] = [p for p in out if p[0].day == 1]
    frame = spark.createDataFrame([r for truck, g in given.items() for r in rows(g, truck)], SCHEMA)
    got = {}
    for r in stops.find_stops(frame).orderBy("truckId", "cluster").collect():
        got.setdefault(r.truckId, []).append(r)
    for truck, g in given.items():
        want = model_stops(g)
        assert [r.points for r in got.get(truck, [])] == [w[2] for w in want]
        assert [r.radius for r in got.get(truck, [])] == pytest.approx([w[5] for w in want], abs=1e-6)
    members = stops.assign_clusters(frame).groupBy("truckId", "cluster").count().where("count > 1").count()
    assert members >= sum(len(v) for v in got.values())


def test_minutes_are_cut_off(spark):
    day = datetime(2024, 1, 1, 8)
    kept = [(day + timedelta(seconds=59), 1.0, 1.0, 0.0), (day + timedelta(minutes=10), 1.0, 1.0, 0.0)]
    gone = [(day, 1.0, 1.0, 0.0), (day + timedelta(minutes=9, seconds=59), 1.0, 1.0, 0.0)]
    assert stops.find_stops(points(spark, kept)).count() == 1
    assert stops.find_stops(points(spark, gone)).count() == 0


def merged(spark, places):
    found = [(32, "T1", i + 1, lat, lon, 0.0, "8:0", "8:10", 2, 10.0) for i, (lat, lon) in enumerate(places)]
    return stops.merge_stops(spark.createDataFrame(found, "dateNum int, truckId string, cluster int, lat double, lon double, radius double, start string, stop string, points long, minutes double"))


def test_a_stop_may_join_two_anchors(spark):
    got = {(r.stop_id, r.cluster) for r in merged(spark, [(0.0, 0.0), (0.00027, 0.0), (0.000135, 0.0)]).collect()}
    assert got == {(1, 1), (2, 2), (1, 3), (2, 3)}


def test_merge_matches_a_plain_model(spark):
    from tests.helpers import km

    rng = random.Random(5)
    places = [(rng.choice([89.9, 0.0, -33.0]) + rng.uniform(0, 4e-4), rng.choice([179.9999, -180.0, 10.0]) + rng.uniform(0, 4e-4)) for _ in range(150)]
    anchors, want = [], set()
    for i, p in enumerate(places):
        near_ = [k for k, a in enumerate(anchors) if km(a, p) <= 0.02]
        if not near_:
            anchors.append(p)
            near_ = [len(anchors) - 1]
        want |= {(k + 1, i + 1) for k in near_}
    assert {(r.stop_id, r.cluster) for r in merged(spark, places).collect()} == want


def plain_members(places):
    from tests.helpers import km

    anchors, want = [], set()
    for i, p in enumerate(places):
        near_ = [k for k, a in enumerate(anchors) if km(a, p) <= 0.02]
        if not near_:
            anchors.append(p)
            near_ = [len(anchors) - 1]
        want |= {(k + 1, i + 1) for k in near_}
    return want


@pytest.mark.parametrize(("n", "side", "most"), [(60, 32, 200_000), (1000, 32, 200_000), (60, 4, 30)])
def test_a_line_of_stops_takes_few_rounds(spark, monkeypatch, n, side, most):
    monkeypatch.setattr(stops, "TILE", side)
    monkeypatch.setattr(stops, "TILE_ROWS", most)
    halves, inner = [], stops._anchors
    monkeypatch.setattr(stops, "_anchors", lambda *a: halves.extend(inner(*a)) or halves)
    places = [(-33.0 + i * 10 / 111_229, -70.6) for i in range(n)]
    assert {(r.stop_id, r.cluster) for r in merged(spark, places).collect()} == plain_members(places)
    assert n == 60 and side == 4 or len(halves) <= 2 * 5


def test_a_crowd_of_stops_is_settled_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(stops, "TILE", 3)
    rng = random.Random(8)
    places = [(-33.0 + rng.uniform(0, 2e-3), -70.6 + rng.uniform(0, 2e-3)) for _ in range(600)]
    assert {(r.stop_id, r.cluster) for r in merged(spark, places).collect()} == plain_members(places)


@pytest.mark.parametrize("exclusive", [False, True])
def test_new_days_are_merged_into_stored_stops(spark, exclusive):
    rng = random.Random(6)
    columns = "dateNum int, truckId string, cluster int, lat double, lon double, radius double, start string, stop string, points long, minutes double"
    found = [(d, f"T{t}", c, -33.0 + rng.uniform(0, 1e-3), -70.6 + rng.uniform(0, 1e-3), 0.0, "8:0", "8:10", 2, 10.0) for d in range(32, 38) for t in range(4) for c in range(1, 6)]
    frame = lambda rows: spark.createDataFrame(rows, columns)
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = stops.merge_stops(frame(found), exclusive=exclusive)
    for old, new in (([r for r in found if r[0] < 35], [r for r in found if r[0] >= 35]), ([r for r in found if (r[0], r[1]) != (34, "T2")], [r for r in found if (r[0], r[1]) == (34, "T2")]), ([], found)):
        stored = stops.merge_stops(frame(old), exclusive=exclusive)
        day, rows = stops.extend_stops(stored, frame(new), exclusive=exclusive)
        assert told(stored.where(stored.dateNum < day).unionByName(rows)) == told(want)
    assert stops.extend_stops(want, frame([]))[0] is None


def test_merge_takes_only_the_nearest_if_asked(spark):
    found = [(32, "T1", i + 1, lat, 0.0, 0.0, "8:0", "8:10", 2, 10.0) for i, lat in enumerate((0.0, 0.00027, 0.00014))]
    frame = spark.createDataFrame(found, "dateNum int, truckId string, cluster int, lat double, lon double, radius double, start string, stop string, points long, minutes double")
    assert {(r.stop_id, r.cluster) for r in stops.merge_stops(frame, exclusive=True).collect()} == {(1, 1), (2, 2), (2, 3)}
    assert stops.merge_stops(frame.limit(0)).count() == 0


def test_distance_and_clock_are_parameters(spark):
    flat = stops.Measure(lambda a, b, c, d: abs(a - c) + abs(b - d), lambda a, b, c, d: abs(a - c) + abs(b - d))
    found = stops.find_stops(points(spark, single(15)), reach_km=1.0, measure=flat, said=lambda s: f"{s // 3600:02d}h{s // 60 % 60:02d}").collect()
    assert [(r.start, r.stop, round(r.radius, 9)) for r in found] == [("09h00", "09h15", 4e-5)]
    pairs = dwell.pair_distances(spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 3.0, 4.0)], "g string, k int, lat double, lon double"), "g", "k", lambda a, b, c, d: F.abs(F.col(a) - F.col(c)) + F.abs(F.col(b) - F.col(d)))
    assert {r.km for r in pairs.collect()} == {7.0}


def props(spark, found):
    return spark.createDataFrame([(i + 1, s, "T1", d, lat, -70.6, minutes, time, 0.0) for i, (s, d, lat, minutes, time) in enumerate(found)], "id int, stopPropId int, truckId string, dateNum int, lat double, lon double, duration_min double, time string, radius double")


def test_long_dwells_test_the_fence_once_a_stop(spark):
    given = props(spark, [(1, 32, 10.0, 300.0, "08:00:00"), (1, 33, -33.4, 300.0, "08:00:00"), (1, 34, 10.0, 300.0, "08:00:00")])
    assert sorted(r.id for r in dwell.depots(given).collect()) == [2, 3]
    assert [r.id for r in dwell.depots(given, strict=True).collect()] == [2]


def test_schedule_keeps_the_last_of_equal_times(spark):
    given = props(spark, [(1, 32, 1.0, 10.0, "08:00:00"), (2, 32, 2.0, 20.0, "08:00:00"), (3, 32, 3.0, 30.0, "07:00:00")])
    made = spark.createDataFrame([(i, float(i), -70.6) for i in (1, 2, 3)], "id int, lat double, lon double")
    assert [(r.time, r.lat) for r in dwell.schedule(given, made, "T1", 32).collect()] == [("07:00:00", 3.0), ("08:00:00", 2.0)]


def test_availability(spark):
    frame = points(spark, single(3)).unionByName(points(spark, [(datetime(2014, 8, 12), 1.0, 2.0, 0.0)], "T2"))
    got = {(r.dateNum, r.truckId): (r.available, r.lat) for r in fleet.availability(frame).collect()}
    assert got[259, "T2"] == (False, None)
    assert got[260, "T2"] == (True, 1.0)
    by_day = {r.dateNum: r for r in fleet.truck_dates(frame).collect()}
    assert by_day[260].availability == {"T1": False, "T2": True}
    assert by_day[260].routeCenters["T1"] is None


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0), (1, 0), 111.229833), ((90, 0), (-90, 0), 20021.369981), ((0, 179), (0, -179), 222.459666), ((5, 5), (5, 5), 0.0)])
def test_distances(spark, a, b, want):
    row = spark.range(1).select(kilometres(*a, *b).alias("km"), miles(*a, *b).alias("mi"), kilometres(F.lit(None).cast("double"), *a[1:], *b).alias("none")).first()
    assert row.km == pytest.approx(want, abs=1e-5)
    assert row.mi == pytest.approx(want / 6373 * 3960, abs=1e-4)
    assert row.none is None


def test_clocks_and_units(spark):
    row = spark.range(1).select(
        clock.clock(F.lit("08:05:59")).alias("c"), clock.seconds(F.lit("24:00:00")).alias("s"), clock.minutes(F.lit("08:00:59")).alias("m"), clock.minutes_between(F.lit("23:50"), F.lit("0:10")).alias("d"),
        clock.date_num(F.lit("2024-06-30").cast("timestamp")).alias("n"), units.speed_mps(F.lit(36.0), "KPH").alias("kph"), units.speed_mps(F.lit(60.0), "mph").alias("mph"), units.altitude_m(F.lit(100.0), "ft").alias("ft"),
        clock.iso(clock.time_of_serial(F.lit(41862.5))).alias("serial"), F.date_format(clock.day_of_serial(F.lit("11-8-2014")), "yyyy-MM-dd").alias("day"),
    ).first()
    assert (row.c, row.s, row.m, row.d, row.n) == ("8:5", 86400, 480, -1420, 216)
    assert (row.kph, row.mph, row.ft) == pytest.approx((10.0, 26.8224, 30.48))
    assert (row.serial, row.day) == ("2014-08-11T12:00:00", "2014-08-11")
    with pytest.raises(ValueError):
        units.speed_mps("x", "furlongs")


@pytest.mark.parametrize(("text", "want"), [("1714568400", "2024-05-01T13:00:00"), ("1714568400000", "2024-05-01T13:00:00"), ("2024-05-01T13:00:00Z", "2024-05-01T13:00:00"), ("2024-05-01T15:00:00+02:00", "2024-05-01T13:00:00"), ("2024/05/01 13:00:00", "2024-05-01T13:00:00"), ("invalid-date", None)])
def test_repaired_times(spark, text, want):
    assert spark.range(1).select(clock.iso(clock.repaired(F.lit(text))).alias("t")).first().t == want


def test_near_and_fence(spark):
    grid = spark.createDataFrame([(37.77 + i * 0.01, -122.42 + j * 0.01) for i in range(5) for j in range(5)], "lat double, lon double")
    found = near(grid, 37.79, -122.40, 1500.0)
    assert found.count() == 9
    assert found.first().distance_m == 0.0
    assert grid.where(inside("lat", "lon", (37.79, -122.40), 0.5)).count() == 1


def test_numbers_over_partitions(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.v == r.seq_no for r in lookups.numbered(frame, ["v"]).collect())


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (20, 20)], "u long, v long")
    assert {(r.node, r.root) for r in graph.connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10), (13, 10)}


def test_line_format(spark):
    row = spark.range(1).select(export.line(F.lit("a"), F.lit("b"), F.lit("c")).alias("x"), export.line().alias("y")).first()
    assert (row.x, row.y) == ("a,b,c\n", "")


def test_addresses(spark):
    rows_ = spark.createDataFrame([(1, 10.0, 20.0), (2, 50.0, 20.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([(10.001, 20.0, "near"), (10.004, 20.0, "far")], "lat double, lon double, address string")
    assert {(r.id, r.address) for r in dwell.nearest_address(rows_, places, 1.0).collect()} == {(1, "near"), (2, None)}


def test_orders(spark):
    frame = points(spark, list(reversed(single(15)))).repartition(4)
    got = [r.seq for r in lookups.device_range(frame, "T1", "2014-08-11 09:00:00", "2014-08-11 09:10:00", "truckId", "ts").collect()]
    assert got == list(range(15, 4, -1))
    grid = spark.createDataFrame([(37.0 + i * 0.001, -122.0) for i in (3, 1, 2, 0)], "lat double, lon double").repartition(3)
    assert [round(r.lat, 3) for r in near(grid, 37.0, -122.0, 1000.0).collect()] == [37.0, 37.001, 37.002, 37.003]


def test_exports(spark, tmp_path):
    made = spark.createDataFrame([(1, 10.0, 20.0)], "id int, lat double, lon double")
    export.write_csv(export.stops_export(made), f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out").first()
    assert (back.id, back.lat, back.lng, back.address) == ("1", "10.0", "20.0", None)


def test_points_lie_by_device_and_time(spark):
    frame = spark.range(1000).select(F.concat(F.lit("D"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("device_id"), (F.col("id") * 37 % 1000).alias("ts_utc"))
    parts = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for r in laid_out(frame.repartition(5)).withColumn("p", F.spark_partition_id()).collect():
            parts.setdefault(r.p, []).append((r.device_id, r.ts_utc))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1
    assert all(p == sorted(p) for p in parts.values())
    assert max(map(len, parts.values())) < 700  # the busy device is spread
