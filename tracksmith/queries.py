"""The registered queries of the trajectory engine. Each reads the given tables whole; SQL for them stands in oracles.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import checks, clock, collections, units
from .functions.geo import euclidean, geojson, inside, kilometres, metres, miles, near, point, to_degrees, to_metres, unpack, within_box
from .operators import dwell, export, fleet, graph, lookups, metrics, places, stops, store
from .oracles import ORACLES
from .plans import ingest
from .sources import readers
from .sources.mapping import MappingPlan
from .sources.projection import gps, raw_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: A day and a truck that every scale factor has; the moment against which times are checked; the fence of the fence queries.
DAY, TRUCK, AS_OF = 1 * 31 + 15, "DEV-3", datetime(2024, 6, 1)
FENCE = (-33.43, -70.62)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Distances, times and counts.


@query
def f01_truck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.truck_counts(gps(spark, sf_dir))


@query
def f02_total_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.total_distance(gps(spark, sf_dir)), "distance_km")


@query
def f03_time_on_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.time_on_road(gps(spark, sf_dir)), "road_hours")


@query
def f04_avg_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_speed(gps(spark, sf_dir)), "avg_kmh", digits=5)


@query
def f05_gps_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.gps_frequency(gps(spark, sf_dir)), "frequency_s")


@query
def f06_segment_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.segment_speed(gps(spark, sf_dir)), "mph", digits=4)


@query
def f08_route_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.route_statistics(gps(spark, sf_dir)), "distance_km", "avg_kmh", digits=5)


@query
def f13_zero_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zero_velocity(gps(spark, sf_dir).withColumn("velocity", F.floor("velocity")))


@query
def f16_date_by_datenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.date_of(gps(spark, sf_dir))


@query
def d01_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.distinct_values(gps(spark, sf_dir), "truckId", "dateNum")


@query
def d02_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookups.extents(gps(spark, sf_dir)), "min_lat", "max_lat", "min_lon", "max_lon")


# Lookups.


@query
def c03_truck_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookups.truck_points(gps(spark, sf_dir), TRUCK).select("truckId", "dateNum", "seq", "time", "lat", "lon"), "lat", "lon", digits=9)


@query
def c04_points_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.points_of_day(gps(spark, sf_dir), DAY).select("truckId", F.size("points").cast("long").alias("n"), F.col("points")[0]["seq"].alias("first_seq"), F.element_at("points", -1)["seq"].alias("last_seq"))


@query
def c09_device_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.device_range(gps(spark, sf_dir), TRUCK, "2024-01-05 06:00:00", "2024-01-08 18:00:00", "truckId", "ts")
    return found.select("truckId", "seq", "time", "dateNum")


@query
def c10_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return lookups.existing(table(spark, sf_dir, "events").select("event_id", "user_id"), stored, "user_id").select("event_id", "user_id")


@query
def c11_sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.sampled(gps(spark, sf_dir), by=("truckId",)).select("truckId", "seq", F.round(point().lat, 9).alias("lat"), F.round(point().lon, 9).alias("lon"))


@query
def d05_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.numbered(gps(spark, sf_dir).select("seq", "truckId"), ["seq"], name="idx")


# The fleet.


@query
def e04_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's device, as the ten trucks have points on every day."""
    device = F.concat(F.lit("DEV-"), F.col("user_id").cast("string"))
    points = table(spark, sf_dir, "events").select(device.alias("truckId"), clock.date_num("ts").alias("dateNum"), F.col("value").alias("lat"), F.col("value").alias("lon"))
    return fleet.availability(points).select("dateNum", "truckId", "available")


@query
def e05_route_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fleet.route_centers(gps(spark, sf_dir)), "lat", "lon", digits=9)


# Stops.


def _stop_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stops.stop_tables(stops.merge_stops(stops.find_stops(gps(spark, sf_dir))))


@query
def l01_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.assign_clusters(gps(spark, sf_dir)).select("truckId", "dateNum", "seq", "cluster")


@query
def l01_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stops.find_stops(gps(spark, sf_dir)).drop("radius"), "lat", "lon", digits=9)


@query
def f10_stop_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stops.find_stops(gps(spark, sf_dir)).select("truckId", "dateNum", "cluster", "radius"), "radius", digits=5)


@query
def l02_stop_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.merge_stops(stops.find_stops(gps(spark, sf_dir))).select("stop_id", "truckId", "dateNum", "cluster")


@query
def l02_stops_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last third of the days merged into the stops of the others."""
    found = graph.saved(stops.find_stops(gps(spark, sf_dir)))
    first = found.agg(F.percentile("dateNum", 2 / 3)).first()[0] or 0
    stored = stops.merge_stops(found.where(F.col("dateNum") < first))
    day, rows = stops.extend_stops(stored, found.where(F.col("dateNum") >= first))
    kept = stored if day is None else stored.where(F.col("dateNum") < day).unionByName(rows)
    return kept.select("stop_id", "truckId", "dateNum", "cluster")


@query
def l03_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stop_tables(spark, sf_dir)[0], "lat", "lon", digits=9)


@query
def l03_stop_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stop_tables(spark, sf_dir)[1].drop("radius"), "lat", "lon", digits=9)


@query
def l04_simple_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops.find_stops_simple(gps(spark, sf_dir), least_minutes=2.0)
    return rounded(rounded(found.select("truckId", "dateNum", "cluster", "points", "minutes", "radius", "lat", "lon"), "radius", digits=3), "lat", "lon", digits=9)


@query
def e01_stops_for_truck_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return dwell.stops_of(props, made).select("truckId", "dateNum", "stop_id", "id")


@query
def e02_parent_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return rounded(dwell.parent_stop(props, made), "stop_lat", "stop_lon", digits=9)


@query
def e03_popular_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return dwell.popular_stops(props, made, 10, lists=False).select("stop_id", "n", "first_prop")


@query
def e03_popular_stops_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the lists, of stops that few properties belong to."""
    made, props = _stop_tables(spark, sf_dir)
    return dwell.popular_stops(props, made).where("n <= 1000").select("stop_id", "n", F.array_join(F.col("props").cast("array<string>"), ",").alias("props"))


@query
def c06_props_of_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.given(_stop_tables(spark, sf_dir)[1], stopPropId=1).select("id", "truckId", "dateNum")


@query
def c07_props_of_stop_truck_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.given(_stop_tables(spark, sf_dir)[1], stopPropId=15, truckId=TRUCK, dateNum=DAY).select("id", "time", "duration_min")


@query
def e07_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the merged stops, which are few for each truck: the stops that a truck visits."""
    made, props = _stop_tables(spark, sf_dir)
    visited = props.select("truckId", F.col("stopPropId").alias("stop")).distinct().join(made, F.col("stop") == made["id"])
    return rounded(dwell.pair_distances(visited, "truckId", "stop"), "km", digits=5)


@query
def f07_stop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, props = _stop_tables(spark, sf_dir)
    after = Window.partitionBy("truckId").orderBy("id")
    pairs = props.select(F.col("id").alias("a"), F.lead("id").over(after).alias("b")).where("b is not null")
    return rounded(metrics.stop_distance(props, pairs), "km", digits=2)


@query
def f14_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.time_windows(_stop_tables(spark, sf_dir)[1], lists=False).select(F.round("hours", 6).alias("hours"), "n", "first_prop")


@query
def f14_time_windows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.time_windows(_stop_tables(spark, sf_dir)[1], whole_hours=True, lists=False).select("hours", "n")


@query
def f15_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return rounded(dwell.schedule(props, made), "lat", "lon", digits=9)


def _fence() -> Column:
    return inside("lat", "lon", FENCE, 3.0)


@query
def g01_long_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.long_dwells(_stop_tables(spark, sf_dir)[1], 2.0, _fence()).select("id", "stopPropId", "duration_min")


@query
def g01_long_dwell_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.long_dwells(_stop_tables(spark, sf_dir)[1], 2.0, _fence(), strict=True).select("id", "stopPropId", "duration_min")


@query
def g02_depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.depots(_stop_tables(spark, sf_dir)[1]).select("id", "stopPropId", "truckId", "dateNum", "duration_min")


@query
def g04_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's nearest customer-like place: the merged stops, as a table of places."""
    made, props = _stop_tables(spark, sf_dir)
    places = made.select("lat", "lon", F.concat(F.lit("stop "), F.col("id").cast("string")).alias("address"))
    return dwell.nearest_address(props.withColumn("address", F.lit("")), places, 0.3).select("id", "address")


# Places.


@query
def g03_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps(spark, sf_dir).where(_fence()).groupBy("truckId").agg(F.count("*").alias("inside"))


@query
def e08_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(gps(spark, sf_dir), *FENCE, 1500.0).select("seq", "truckId", F.round("distance_m", 2).alias("distance_m"))


@query
def b13_near_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e08_near over a stored table in the order of place."""
    kept = store.Store(spark, f"{graph.shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", options={"parquet.block.size": str(1 << 20)})
    graph.remove_at_exit(spark, kept.root)
    kept.overwrite("points", places.by_place(gps(spark, sf_dir), then=["ts", "seq"]))
    return near(kept.read("points"), *FENCE, 1500.0).select("seq", "truckId", F.round("distance_m", 2).alias("distance_m"))


@query
def b13_existing_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of an hour's points a stored table of every other point has, looked up by its Bloom filters if they are few."""
    kept = store.Store(spark, f"{graph.shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    graph.remove_at_exit(spark, kept.root)
    points, _ = ingest.split(_normalized(spark, sf_dir))
    kept.overwrite("track_points", points.where("seq_no % 2 = 0").select("_hash", "seq_no"))
    asked = points.where(F.date_trunc("hour", "ts_utc") == F.lit("2024-01-05 06:00:00").cast("timestamp")).select("_hash", "seq_no")
    return lookups.existing_few(asked, kept.read("track_points")).select("seq_no", "_hash")


@query
def g04_nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's three nearest customers, near or far; customers get places from their numbers, every fiftieth one far off."""
    n = F.col("c_custkey")
    lat = F.lit(-33.9) + (n * 7919 % 10007).cast("double") * 9.7e-5 + F.when(n % 50 == 0, 5.0).otherwise(0.0)
    known = table(spark, sf_dir, "customer").select(n.alias("place"), lat.alias("lat"), (F.lit(-71.1) + (n * 104729 % 10009).cast("double") * 8.3e-5).alias("lon"))
    found = places.nearest(gps(spark, sf_dir).select("seq", "lat", "lon"), known, 3, "place")
    return found.select("seq", F.posexplode("nearest").alias("i", "e")).select("seq", (F.col("i") + 1).alias("rank"), "e.place", F.round("e.km", 2).alias("km"))


@query
def e09_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps(spark, sf_dir).where(within_box(-33.445, -33.415, -70.645, -70.60)).select("seq", "truckId")


@query
def h01_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ("lat", "lon", *FENCE)
    c = gps(spark, sf_dir).select("seq", kilometres(*at).alias("km"), miles(*at).alias("mi"), metres(*at).alias("m"), to_metres("lat").alias("m_lat"), euclidean(F.col("lat"), F.col("lon"), F.lit(FENCE[0]), F.lit(FENCE[1])).alias("squared"))
    return c.select("seq", F.round("km", 5).alias("km"), F.round("mi", 5).alias("mi"), F.round("m", 2).alias("m"), F.round("m_lat", 2).alias("m_lat"), F.round("squared", 8).alias("squared"))


@query
def h05_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("time")
    return gps(spark, sf_dir).select("seq", clock.clock(t).alias("clock"), clock.seconds(t).alias("seconds"), clock.minutes(t).alias("minutes"), F.round(clock.hours(t), 6).alias("hours"))


@query
def h14_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gps(spark, sf_dir).select("seq", geojson().alias("loc"))
    return c.select("seq", F.col("loc.type").alias("type"), F.round(F.col("loc.coordinates")[0], 9).alias("lon"), F.round(F.col("loc.coordinates")[1], 9).alias("lat"))


@query
def l06_grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = gps(spark, sf_dir).select("seq", (F.col("lat") + 0.0000137).alias("lat"), (F.col("lon") + 0.0000137).alias("lon"))
    corner = shifted.withColumn("lat", F.round("lat", 7)).withColumn("lon", F.round("lon", 7))
    return graph.grid_index(corner, "seq", 500.0).select("cell_y", "cell_x", F.size("keys").cast("long").alias("n"), F.col("keys")[0].alias("first_seq"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("end"))


@query
def l07_max_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.max_out_degree(_edges(spark, sf_dir))


@query
def e10_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_edges(spark, sf_dir)).select("node", F.size("edges").cast("long").alias("n"), F.col("edges")[0].alias("first_edge"))


# Ingest.

PLAN = MappingPlan({"device_id": "device_id", "timestamp": "ts_utc", "lat": "lat", "lon": "lon", "speed_kph": "speed_mps", "heading": "heading_deg", "hdop": "hdop"}, {"speed_mps": "kph"})


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_records(spark, sf_dir)
    return ingest.normalized(raw, PLAN, "job-1", "seq", AS_OF).withColumn("ingest_id", F.concat(F.lit("job-"), (F.col("seq_no") % 3).cast("string")))


@query
def h11_timestamp_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).select("seq", F.unix_seconds(clock.repaired("timestamp")).alias("epoch"))


@query
def h12_unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_id", *[F.round(units.speed_mps("value", u), 6).alias(u) for u in units.SPEED], *[F.round(units.altitude_m("value", u), 6).alias(u) for u in units.ALTITUDE])
    return c


@query
def h13_point_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).where("error is null").select("seq_no", "_hash")


@query
def h15_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select("seq_no", "error")


@query
def h21_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(spark, sf_dir).where("error is null")
    flag = lambda n: F.coalesce(F.try_element_at("quality_flags", F.lit(n)), F.lit(False)).alias(n)
    return rows.select("seq_no", F.round("speed_mps", 6).alias("speed_mps"), "heading_deg", "hdop", flag("flag_speed_spike"), flag("flag_bad_heading"), flag("flag_bad_hdop"))


@query
def b11_dedup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the points come again in a later job, which then owns them."""
    points, _ = ingest.split(_normalized(spark, sf_dir))
    again = points.where("seq_no % 2 = 0").withColumn("ingest_id", F.lit("job-9"))
    return store.upserted(points, again).select("_hash", "ingest_id", "seq_no")


@query
def f17_count_by_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_by_ingest(ingest.split(_normalized(spark, sf_dir))[0])


@query
def f18_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ingest_statistics(_normalized(spark, sf_dir))


@query
def f19_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(spark, sf_dir)
    return metrics.job_status(metrics.ingest_statistics(rows), rows.where("error is null and hdop > 2"))


@query
def d04_error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.error_sample(_normalized(spark, sf_dir), "error", "seq_no")
    return found.select(F.explode("errors").alias("idx", "message"))


@query
def i02_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return c.groupBy("event_type").agg(F.sum("p.k").alias("sum_k"), F.count("p.k").alias("n"))


@query
def b06_stop_props_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = gps(spark, sf_dir)
    made, props = _stop_tables(spark, sf_dir)
    out = export.stop_props_export(props, metrics.date_of(points), DAY)
    return rounded(out, "lat", "lng", digits=9)


@query
def b05_stops_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.stops_export(_stop_tables(spark, sf_dir)[0]), "lat", "lng", digits=9)


@query
def b07_truck_day_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return rounded(export.truck_day_export(props, made, TRUCK, DAY), "lat", "lng", digits=9)


@query
def e11_stop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, props = _stop_tables(spark, sf_dir)
    return rounded(dwell.stop_statistics(props, made, TRUCK).select("id", "stop_id", "dateNum", "time", "duration_min", "stop_lat", "stop_lon"), "stop_lat", "stop_lon", digits=9)


@query
def c05_props_of_truck_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.given(_stop_tables(spark, sf_dir)[1], truckId=TRUCK, dateNum=DAY, stopPropId=None).select("id", "stopPropId", "time")


@query
def f20_availability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.availability_report(gps(spark, sf_dir), [f"DEV-{i}" for i in range(10)])


# Filters, values, and functions of their own.


@query
def c01_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.matching(gps(spark, sf_dir), truckId=TRUCK, dateNum=DAY).select("seq", "time")


@query
def c13_latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each truck's last point."""
    return lookups.by_id(gps(spark, sf_dir), "truckId", "seq").select("truckId", "seq", "time")


@query
def d02_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = gps(spark, sf_dir).groupBy("truckId").agg(F.max("velocity").alias("velocity"))
    return lookups.extreme(points, "velocity").withColumn("which", F.lit("max")).unionByName(lookups.extreme(points, "velocity", largest=False).withColumn("which", F.lit("min")))


@query
def h03_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(to_degrees("value"), 9).alias("degrees"), F.round(unpack(F.col("event_id") * 123_456_780), 9).alias("unpacked"))


@query
def h10_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    serial = F.lit(40_000) + k % 4000 + (k % 4) * 0.25
    text = F.date_format("ts", "d-M-yyyy")
    return table(spark, sf_dir, "events").select("event_id", clock.iso(clock.time_of_serial(serial)).alias("time"), clock.iso(clock.time_of_serial(serial, two_days_late=True)).alias("late"), clock.day_of_serial(text).alias("day"))


@query
def h17_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    moved = F.when(k % 5 == 0, ts - F.expr("INTERVAL 70 YEARS")).when(k % 7 == 0, ts + F.expr("INTERVAL 2 YEARS")).otherwise(ts)
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(checks.time(moved, AS_OF), "is .*$", 0).alias("fault"))


@query
def h22_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = collections.multimap(gps(spark, sf_dir).select("truckId", "dateNum").distinct(), "truckId", "dateNum", "days")
    counts = gps(spark, sf_dir).groupBy("truckId", "dateNum").count().groupBy("truckId").agg(collections.map_of("dateNum", "count").alias("by_day"))
    joined = days.where(collections.not_empty("days")).join(counts, "truckId")
    return joined.select("truckId", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"), collections.get_or("by_day", DAY, F.lit(0).cast("long")).alias("on_day"), collections.get_or("by_day", -1, F.lit(-1).cast("long")).alias("never"))


@query
def i02_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", collections.canonical_json(pairs).alias("json"))


# Readers: a table written in the format, and read again.


def _written(df: DataFrame, kind: str) -> str:
    """The path of df, written in the shared folder; the folder goes with the driver."""
    path = f"{graph.shared_dir(df.sparkSession).rstrip('/')}/read-{uuid.uuid4().hex}.{kind}"
    graph.remove_at_exit(df.sparkSession, path)
    (df.write.option("header", True) if kind == "csv" else df.write).format(kind).save(path)
    return path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


def _read(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = readers.read_any(spark, _written(_events(spark, sf_dir), kind))
    at = F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", at.alias("at"))


@query
def a03_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "csv")


@query
def a04_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "json")


@query
def a06_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "parquet")


@query
def l11_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as CSV, ingested as a file, and the job's counts with the points stored."""
    kept = store.Store(spark, f"{graph.shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    graph.remove_at_exit(spark, kept.root)
    job = ingest.ingest_file(kept, _written(raw_records(spark, sf_dir).drop("seq"), "csv"), plan=PLAN, as_of=AS_OF)
    stats = kept.job(job).select("status", "stats.*")
    return stats.crossJoin(kept.read("track_points").agg(F.count("*").alias("stored"), F.count_if(F.col("quality_flags").isNotNull()).alias("flagged")))  # one row each


@query
def b08_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps(spark, sf_dir).select("seq", export.line("truckId", F.col("dateNum").cast("string"), "time").alias("line"))


# Labelled extensions: not among the reference's operators.


@query
def x01_distance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = metrics.segments(gps(spark, sf_dir)).rollup("truckId", "dateNum").agg(metrics.total_km().alias("distance_km"))
    return rounded(rolled, "distance_km", digits=4)


@query
def x02_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips: runs of points with gaps under an hour."""
    windows = gps(spark, sf_dir).groupBy("truckId", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("points"))
    return windows.select("truckId", F.unix_seconds("w.start").alias("start"), "points")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
