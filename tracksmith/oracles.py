"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

import math

_RAD = f"{math.pi / 180!r}::DOUBLE"
_FENCE = ("(-33.43)::DOUBLE", "(-70.62)::DOUBLE")
_CITY = ("(-33.469994)::DOUBLE", "(-70.642193)::DOUBLE")
_DAY, _TRUCK = 46, "DEV-3"


def _dist(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6373") -> str:
    p, q = f"((90::DOUBLE - {lat1}) * {_RAD})", f"((90::DOUBLE - {lat2}) * {_RAD})"
    c = f"sin({p}) * sin({q}) * cos({lon1} * {_RAD} - {lon2} * {_RAD}) + cos({p}) * cos({q})"
    return f"(CASE WHEN {lat1} IS NULL OR {lat2} IS NULL THEN NULL WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0::DOUBLE ELSE acos(least(1::DOUBLE, greatest(-1::DOUBLE, {c}))) * {radius}::DOUBLE END)"


_GPS = """gps AS (
  SELECT event_id AS seq, ts, 'DEV-' || (user_id % 10) AS "truckId", strftime(ts, '%H:%M:%S') AS time, value AS velocity,
    (extract(month FROM ts) * 31 + extract(day FROM ts))::INTEGER AS "dateNum",
    extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))::BIGINT AS sec,
    (-33.45)::DOUBLE + (user_id % 10)::DOUBLE * 0.01::DOUBLE + (extract(hour FROM ts) // 6)::DOUBLE * 0.005::DOUBLE
      + CASE WHEN event_type = 'error' THEN (event_id % 97)::DOUBLE * 0.0005::DOUBLE ELSE (event_id % 3 - 1)::DOUBLE * 0.00002::DOUBLE END AS lat,
    (-70.65)::DOUBLE + (user_id % 10)::DOUBLE * 0.01::DOUBLE
      + CASE WHEN event_type = 'error' THEN (event_id % 89)::DOUBLE * 0.0005::DOUBLE ELSE (event_id % 3 - 1)::DOUBLE * 0.00002::DOUBLE END AS lon
  FROM events)"""

_SEG = f"""{_GPS},
lagged AS (
  SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(sec) OVER w AS sec0 FROM gps
  WINDOW w AS (PARTITION BY "truckId", "dateNum" ORDER BY ts, seq)),
seg AS (SELECT *, {_dist("lat0", "lon0", "lat", "lon")} AS km, sec - sec0 AS dt FROM lagged)"""

_WALK = f"""{_GPS},
pts AS (SELECT *, row_number() OVER (PARTITION BY "truckId", "dateNum" ORDER BY ts, seq) AS rn FROM gps),
walk AS (
  SELECT "truckId", "dateNum", rn, seq, sec, lat, lon, 1 AS cluster, 1 AS n, lat AS slat, lon AS slon FROM pts WHERE rn = 1
  UNION ALL
  SELECT "truckId", "dateNum", rn, seq, sec, lat, lon, CASE WHEN inside THEN cluster ELSE cluster + 1 END, CASE WHEN inside THEN n + 1 ELSE 1 END,
         CASE WHEN inside THEN slat + lat ELSE lat END, CASE WHEN inside THEN slon + lon ELSE lon END
  FROM (SELECT p."truckId", p."dateNum", p.rn, p.seq, p.sec, p.lat, p.lon, w.cluster, w.n, w.slat, w.slon,
               {_dist("(w.slat / w.n)", "(w.slon / w.n)", "p.lat", "p.lon")} < 0.02::DOUBLE AS inside
        FROM walk w JOIN pts p ON p."truckId" = w."truckId" AND p."dateNum" = w."dateNum" AND p.rn = w.rn + 1))"""

_STOPS = f"""{_WALK},
agg AS (SELECT "truckId", "dateNum", cluster, count(*) AS points, avg(lat) AS lat, avg(lon) AS lon, min(sec) AS lo, max(sec) AS hi FROM walk GROUP BY ALL),
found AS (SELECT *, (hi // 60 - lo // 60)::DOUBLE AS minutes, (lo // 3600) || ':' || (lo // 60 % 60) AS start, (hi // 3600) || ':' || (hi // 60 % 60) AS stop
          FROM agg WHERE points >= 2 AND hi // 60 - lo // 60 >= 10)"""

_MERGE = f"""{_STOPS},
rows_ AS (SELECT *, row_number() OVER (ORDER BY "dateNum", "truckId", cluster) AS k FROM found),
lead_ AS (
  SELECT 0::BIGINT AS k, CAST([] AS STRUCT(k BIGINT, lat DOUBLE, lon DOUBLE)[]) AS anchors
  UNION ALL
  SELECT r.k, CASE WHEN len(list_filter(l.anchors, lambda a: {_dist("a.lat", "a.lon", "r.lat", "r.lon")} <= 0.02::DOUBLE)) = 0
                   THEN list_append(l.anchors, {{'k': r.k, 'lat': r.lat, 'lon': r.lon}}) ELSE l.anchors END
  FROM lead_ l JOIN rows_ r ON r.k = l.k + 1),
last_ AS (SELECT anchors FROM lead_ ORDER BY k DESC LIMIT 1),
anchor AS (SELECT u.a.k AS ak, u.a.lat AS alat, u.a.lon AS alon, u.i::INTEGER AS stop_id FROM (SELECT unnest(anchors) AS a, generate_subscripts(anchors, 1) AS i FROM last_) u),
members AS (SELECT r.*, a.stop_id FROM rows_ r JOIN anchor a ON r.k >= a.ak AND {_dist("a.alat", "a.alon", "r.lat", "r.lon")} <= 0.02::DOUBLE),
stops AS (SELECT stop_id AS id, avg(lat) AS lat, avg(lon) AS lon FROM members GROUP BY stop_id),
props AS (SELECT (row_number() OVER (ORDER BY stop_id, k))::INTEGER AS id, stop_id AS "stopPropId", "truckId", "dateNum", lat, lon, minutes AS duration_min,
                 lpad((lo // 3600)::VARCHAR, 2, '0') || ':' || lpad((lo // 60 % 60)::VARCHAR, 2, '0') || ':00' AS time FROM members)"""

_RAW = """raw AS (
  SELECT event_id AS seq, CASE WHEN event_id % 101 = 0 THEN '  ' ELSE 'DEV-' || (user_id % 10) END AS device_id, date_trunc('second', ts) AS ts_utc,
    CASE WHEN event_id % 50 = 0 THEN 91::DOUBLE ELSE (-33.45)::DOUBLE + (event_id % 100)::DOUBLE * 0.001::DOUBLE END AS lat,
    CASE WHEN event_id % 53 = 0 THEN (-181)::DOUBLE ELSE (-70.65)::DOUBLE + (event_id % 70)::DOUBLE * 0.001::DOUBLE END AS lon,
    CASE WHEN event_id % 37 = 0 THEN 450::DOUBLE ELSE (event_id % 90)::DOUBLE END * (1::DOUBLE / 3.6::DOUBLE) AS speed,
    CASE WHEN event_id % 41 = 0 THEN 400::DOUBLE ELSE (event_id % 360)::DOUBLE END AS heading,
    CASE WHEN event_id % 43 = 0 THEN 12::DOUBLE WHEN event_id % 47 = 0 THEN (-1)::DOUBLE ELSE (event_id % 5)::DOUBLE END AS hdop
  FROM events),
norm AS (
  SELECT seq AS seq_no, ts_utc, 'job-' || (seq % 3) AS ingest_id, device_id, lat, lon, CASE WHEN speed BETWEEN 0 AND 120 THEN speed END AS speed_mps, NOT speed BETWEEN 0 AND 120 AS spike,
    CASE WHEN heading >= 0 AND heading < 360 THEN heading END AS heading_deg, NOT (heading >= 0 AND heading < 360) AS turned,
    CASE WHEN hdop >= 0 THEN hdop END AS hdop, hdop < 0 OR hdop > 10 AS vague,
    CASE WHEN trim(device_id) = '' THEN 'device_id cannot be empty' WHEN lat > 90 THEN 'Latitude 91.0 out of range [-90, 90]' WHEN lon < -180 THEN 'Longitude -181.0 out of range [-180, 180]' END AS error,
    sha256(device_id || ':' || strftime(ts_utc, '%Y-%m-%dT%H:%M:%S') || ':' || printf('%.6f', lat) || ':' || printf('%.6f', lon)) AS _hash
  FROM raw)"""

_EDGES = "edges AS (SELECT o_orderkey AS edge, o_custkey AS s, o_custkey + o_orderkey % 7 AS e FROM orders)"
_KEY = '"truckId", "dateNum"'


def _gps(select: str) -> str:
    return f"WITH {_GPS} {select}"


def _seg(select: str) -> str:
    return f"WITH {_SEG} {select}"


def _walk(select: str) -> str:
    return f"WITH RECURSIVE {_WALK} {select}"


def _stops(select: str) -> str:
    return f"WITH RECURSIVE {_STOPS} {select}"


def _merge(select: str) -> str:
    return f"WITH RECURSIVE {_MERGE} {select}"


def _norm(select: str) -> str:
    return f"WITH {_RAW} {select}"


_ROAD = "coalesce(sum(dt) FILTER (km > 0), 0) / 3600::DOUBLE"
_KM = "coalesce(sum(km), 0)"
_LONG = f"SELECT *, {_dist('lat', 'lon', *_FENCE)} < 3::DOUBLE AS within FROM props WHERE duration_min / 60::DOUBLE > 2"

ORACLES = {
    "f01_truck_counts": _gps('SELECT "truckId", count(*) AS points FROM gps GROUP BY ALL'),
    "f02_total_distance": _seg(f"SELECT {_KEY}, round({_KM}, 6) AS distance_km FROM seg GROUP BY {_KEY}"),
    "f03_time_on_road": _seg(f"SELECT {_KEY}, round({_ROAD}, 6) AS road_hours FROM seg GROUP BY {_KEY}"),
    "f04_avg_speed": _seg(f"SELECT {_KEY}, round({_KM} / nullif({_ROAD}, 0), 5) AS avg_kmh FROM seg GROUP BY {_KEY}"),
    "f05_gps_frequency": _seg(f"SELECT {_KEY}, round(avg(dt), 6) AS frequency_s FROM seg GROUP BY {_KEY}"),
    "f06_segment_speed": _seg(f"SELECT {_KEY}, seq, round(abs({_dist('lat0', 'lon0', 'lat', 'lon', '3960')} / nullif(dt / 3600::DOUBLE, 0)), 4) AS mph FROM seg WHERE dt IS NOT NULL"),
    "f08_route_statistics": _seg(f"SELECT {_KEY}, round({_KM}, 5) AS distance_km, count(*) * 0.5::DOUBLE AS minutes, round({_KM} / (count(*) * 0.5::DOUBLE / 60::DOUBLE), 5) AS avg_kmh FROM seg GROUP BY {_KEY}"),
    "f13_zero_velocity": _gps(f"SELECT {_KEY}, count(*) FILTER (floor(velocity) = 0) AS zeros FROM gps GROUP BY {_KEY}"),
    "f16_date_by_datenum": _gps('SELECT "dateNum", min(ts::DATE) AS date FROM gps GROUP BY "dateNum"'),
    "d01_distinct_pairs": _gps(f"SELECT DISTINCT {_KEY} FROM gps"),
    "d02_extents": _gps("SELECT round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM gps"),
    "c03_truck_points": _gps(f"SELECT {_KEY}, seq, time, round(lat, 9) AS lat, round(lon, 9) AS lon FROM gps WHERE \"truckId\" = '{_TRUCK}'"),
    "c04_points_of_day": _gps(f'SELECT "truckId", count(*) AS n, arg_min(seq, ts) AS first_seq, arg_max(seq, ts) AS last_seq FROM gps WHERE "dateNum" = {_DAY} GROUP BY "truckId"'),
    "c09_device_time_range": _gps(f"SELECT \"truckId\", seq, time, \"dateNum\" FROM gps WHERE \"truckId\" = '{_TRUCK}' AND ts BETWEEN '2024-01-05 06:00:00' AND '2024-01-08 18:00:00'"),
    "c10_existing": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)",
    "c11_sampled_points": _gps('SELECT "truckId", seq, round(lat, 9) AS lat, round(lon, 9) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY "truckId" ORDER BY ts, seq) AS rn FROM gps) WHERE rn % 100 = 1'),
    "d05_row_numbers": _gps('SELECT seq, "truckId", row_number() OVER (ORDER BY seq) - 1 AS idx FROM gps'),
    "e04_availability": """
WITH p AS (SELECT 'DEV-' || user_id AS t, (extract(month FROM ts) * 31 + extract(day FROM ts))::INTEGER AS d FROM events)
SELECT a.d AS "dateNum", b.t AS "truckId", c.t IS NOT NULL AS available
FROM (SELECT DISTINCT d FROM p) a CROSS JOIN (SELECT DISTINCT t FROM p) b LEFT JOIN (SELECT DISTINCT t, d FROM p) c ON c.d = a.d AND c.t = b.t""",
    "e05_route_centers": _gps("""
SELECT d."dateNum", t."truckId", round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM (SELECT DISTINCT "dateNum" FROM gps) d CROSS
JOIN (SELECT DISTINCT "truckId" FROM gps) t LEFT JOIN gps g ON g."dateNum" = d."dateNum" AND g."truckId" = t."truckId" GROUP BY ALL"""),
    "l01_clusters": _walk(f"SELECT {_KEY}, seq, cluster FROM walk"),
    "l01_stops": _stops(f"SELECT {_KEY}, cluster, round(lat, 9) AS lat, round(lon, 9) AS lon, start, stop, points, minutes FROM found"),
    "f10_stop_radius": _stops(f"""
SELECT f."truckId", f."dateNum", f.cluster, round(max({_dist("a.lat", "a.lon", "b.lat", "b.lon")}) / 2, 5) AS radius FROM found f
JOIN walk a ON a."truckId" = f."truckId" AND a."dateNum" = f."dateNum" AND a.cluster = f.cluster
JOIN walk b ON b."truckId" = f."truckId" AND b."dateNum" = f."dateNum" AND b.cluster = f.cluster GROUP BY ALL"""),
    "l02_stop_members": _merge(f"SELECT stop_id, {_KEY}, cluster FROM members"),
    "l02_stops_extended": _merge(f"SELECT stop_id, {_KEY}, cluster FROM members"),
    "l03_stops": _merge("SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM stops"),
    "l03_stop_props": _merge(f'SELECT id, "stopPropId", {_KEY}, round(lat, 9) AS lat, round(lon, 9) AS lon, duration_min, time FROM props'),
    "l04_simple_stops": _walk(f"""
SELECT "truckId", "dateNum", cluster, count(*) AS points, count(*) * 0.5::DOUBLE AS minutes, round(max({_dist("clat", "clon", "lat", "lon")}), 3) AS radius, round(any_value(clat), 9) AS lat, round(any_value(clon), 9) AS lon
FROM (SELECT *, avg(lat) OVER w AS clat, avg(lon) OVER w AS clon FROM walk WINDOW w AS (PARTITION BY "truckId", "dateNum", cluster))
GROUP BY "truckId", "dateNum", cluster HAVING count(*) * 0.5 >= 2"""),
    "e01_stops_for_truck_day": _merge(f'SELECT {_KEY}, "stopPropId" AS stop_id, min(id) AS id FROM props GROUP BY ALL'),
    "e02_parent_stop": _merge('SELECT p.id, s.id AS stop_id, round(s.lat, 9) AS stop_lat, round(s.lon, 9) AS stop_lon FROM props p JOIN stops s ON s.id = p."stopPropId"'),
    "e03_popular_stops": _merge('SELECT "stopPropId" AS stop_id, count(*) AS n, min(id) AS first_prop FROM props GROUP BY ALL HAVING count(*) >= 10'),
    "e03_popular_stops_lists": _merge("""SELECT "stopPropId" AS stop_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS props FROM props GROUP BY ALL HAVING count(*) <= 1000"""),
    "c06_props_of_stop": _merge('SELECT id, "truckId", "dateNum" FROM props WHERE "stopPropId" = 1'),
    "c07_props_of_stop_truck_date": _merge(f"""SELECT id, time, duration_min FROM props WHERE "stopPropId" = 15 AND "truckId" = '{_TRUCK}' AND "dateNum" = {_DAY}"""),
    "e07_pair_distances": _merge(f"""
SELECT a."truckId", a."stopPropId" AS a, b."stopPropId" AS b, round({_dist("s.lat", "s.lon", "t.lat", "t.lon")}, 5) AS km
FROM (SELECT DISTINCT "truckId", "stopPropId" FROM props) a JOIN (SELECT DISTINCT "truckId", "stopPropId"
FROM props) b ON a."truckId" = b."truckId" AND a."stopPropId" <> b."stopPropId" JOIN stops s ON s.id = a."stopPropId"
JOIN stops t ON t.id = b."stopPropId"
"""),
    "f07_stop_distance": _merge(f"""
SELECT a, b, round({_dist("lat", "lon", "lat2", "lon2")}, 2) AS km
FROM (SELECT id AS a, lead(id) OVER w AS b, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
FROM props WINDOW w AS (PARTITION BY "truckId" ORDER BY id)) WHERE b IS NOT NULL"""),
    "f14_time_windows": _merge("SELECT round(duration_min / 60::DOUBLE, 6) AS hours, count(*) AS n, min(id) AS first_prop FROM props WHERE duration_min / 60::DOUBLE < 4 GROUP BY duration_min"),
    "f14_time_windows_whole": _merge("SELECT floor(duration_min / 60::DOUBLE) AS hours, count(*) AS n FROM props WHERE duration_min / 60::DOUBLE < 4 GROUP BY ALL"),
    "f15_schedule": _merge(f"""
SELECT {_KEY}, time, round(lat, 9) AS lat, round(lon, 9) AS lon, duration_min
FROM (SELECT *, row_number() OVER (PARTITION BY "truckId", "dateNum", time ORDER BY id DESC) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY "truckId", "dateNum", "stopPropId" ORDER BY id) AS f FROM props) WHERE f = 1) WHERE n = 1"""),
    "g01_long_dwell": _merge(f'SELECT id, "stopPropId", duration_min FROM (SELECT *, bool_or(within) OVER (PARTITION BY "stopPropId" ORDER BY id ROWS UNBOUNDED PRECEDING) AS seen FROM ({_LONG})) WHERE seen'),
    "g01_long_dwell_strict": _merge(f'SELECT id, "stopPropId", duration_min FROM ({_LONG}) WHERE within'),
    "g02_depots": _merge(f"""
SELECT id, "stopPropId", {_KEY}, duration_min
FROM (SELECT *, bool_or({_dist("lat", "lon", *_CITY)} < 60::DOUBLE) OVER (PARTITION BY "stopPropId" ORDER BY id ROWS UNBOUNDED PRECEDING) AS seen
FROM props WHERE duration_min / 60::DOUBLE > 4) WHERE seen"""),
    "g04_addresses": _merge(f"SELECT p.id, arg_min('stop ' || s.id, {_dist('p.lat', 'p.lon', 's.lat', 's.lon')}) AS address FROM props p LEFT JOIN stops s ON {_dist('p.lat', 'p.lon', 's.lat', 's.lon')} <= 0.3::DOUBLE GROUP BY p.id"),
    "g03_geofence": _gps(f'SELECT "truckId", count(*) AS inside FROM gps WHERE {_dist("lat", "lon", *_FENCE)} < 3::DOUBLE GROUP BY ALL'),
    "e08_near": _gps(f'SELECT seq, "truckId", round({_dist("lat", "lon", *_FENCE, "6373000")}, 2) AS distance_m FROM gps WHERE {_dist("lat", "lon", *_FENCE, "6373000")} <= 1500'),
    "b13_near_by_place": _gps(f'SELECT seq, "truckId", round({_dist("lat", "lon", *_FENCE, "6373000")}, 2) AS distance_m FROM gps WHERE {_dist("lat", "lon", *_FENCE, "6373000")} <= 1500'),
    "g04_nearest_places": _gps(f"""
, place AS (SELECT c_custkey AS place, (-33.9)::DOUBLE + (c_custkey * 7919 % 10007)::DOUBLE * 9.7e-5::DOUBLE + CASE WHEN c_custkey % 50 = 0 THEN 5 ELSE 0 END::DOUBLE AS lat,
  (-71.1)::DOUBLE + (c_custkey * 104729 % 10009)::DOUBLE * 8.3e-5::DOUBLE AS lon FROM customer),
spot AS (SELECT DISTINCT lat, lon FROM gps),
ranked AS (SELECT s.lat, s.lon, p.place, {_dist("s.lat", "s.lon", "p.lat", "p.lon")} AS km, row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY {_dist("s.lat", "s.lon", "p.lat", "p.lon")}, p.place) AS rank FROM spot s, place p QUALIFY rank <= 3)
SELECT seq, rank::INTEGER AS rank, place, round(km, 2) AS km FROM gps JOIN ranked USING (lat, lon)"""),
    "e09_bbox": _gps('SELECT seq, "truckId" FROM gps WHERE lat BETWEEN -33.445 AND -33.415 AND lon BETWEEN -70.645 AND -70.60'),
    "h01_distances": _gps(f"""
SELECT seq, round({_dist('lat', 'lon', *_FENCE)}, 5) AS km, round({_dist('lat', 'lon', *_FENCE, '3960')}, 5) AS mi, round({_dist('lat', 'lon', *_FENCE, '6373000')}, 2) AS m, round(lat * 100000, 2) AS m_lat, round(pow(lat - {_FENCE[0]}, 2) + pow(lon - {_FENCE[1]}, 2), 8) AS squared
FROM gps"""),
    "h05_clock": _gps("SELECT seq, (sec // 3600) || ':' || (sec // 60 % 60) AS clock, sec::INTEGER AS seconds, (sec // 60)::INTEGER AS minutes, round((sec // 3600) + (sec // 60 % 60) / 60::DOUBLE + (sec % 60) / 3600::DOUBLE, 6) AS hours FROM gps"),
    "h14_geojson": _gps("SELECT seq, 'Point' AS type, round(lon, 9) AS lon, round(lat, 9) AS lat FROM gps"),
    "l06_grid_index": _gps("""
SELECT floor((lat - lo) * 100000::DOUBLE / 500::DOUBLE)::BIGINT AS cell_y, floor((lon - le) * 100000::DOUBLE / 500::DOUBLE)::BIGINT AS cell_x, count(*) AS n, min(seq) AS first_seq
FROM (SELECT *, min(lat) OVER () AS lo, min(lon) OVER () AS le
FROM (SELECT seq, round(lat + 0.0000137::DOUBLE, 7) AS lat, round(lon + 0.0000137::DOUBLE, 7) AS lon FROM gps)) GROUP BY ALL"""),
    "l07_max_degree": f"WITH {_EDGES} SELECT max(c) AS max_out_degree FROM (SELECT s, count(*) AS c FROM edges GROUP BY s)",
    "e10_adjacency": f"WITH {_EDGES} SELECT node, count(DISTINCT edge) AS n, min(edge) AS first_edge FROM (SELECT s AS node, edge FROM edges UNION ALL SELECT e, edge FROM edges) GROUP BY node",
    "h11_timestamp_repair": _norm("SELECT seq, epoch(ts_utc)::BIGINT AS epoch FROM raw"),
    "h12_unit_conversion": """
SELECT event_id, round(value, 6) AS mps, round(value * (1::DOUBLE / 3.6::DOUBLE), 6) AS kph, round(value * 0.44704::DOUBLE, 6) AS mph, round(value * 0.514444::DOUBLE, 6) AS knots, round(value, 6) AS m, round(value * 0.3048::DOUBLE, 6) AS ft, round(value * 1000::DOUBLE, 6) AS km
FROM events""",
    "h13_point_hash": _norm("SELECT seq_no, _hash FROM norm WHERE error IS NULL"),
    "b13_existing_hashes": _norm("SELECT seq_no, _hash FROM norm WHERE error IS NULL AND date_trunc('hour', ts_utc) = TIMESTAMP '2024-01-05 06:00:00' AND _hash IN (SELECT _hash FROM norm WHERE error IS NULL AND seq_no % 2 = 0)"),
    "h15_validation": _norm("SELECT seq_no, error FROM norm"),
    "h21_quality_flags": _norm("SELECT seq_no, round(speed_mps, 6) AS speed_mps, heading_deg, hdop, spike AS flag_speed_spike, turned AS flag_bad_heading, vague AS flag_bad_hdop FROM norm WHERE error IS NULL"),
    "b11_dedup_upsert": _norm("""
SELECT _hash, CASE WHEN max(seq_no) FILTER (seq_no % 2 = 0) IS NOT NULL THEN 'job-9' ELSE any_value(ingest_id) END AS ingest_id, coalesce(max(seq_no) FILTER (seq_no % 2 = 0), any_value(seq_no)) AS seq_no
FROM norm WHERE error IS NULL GROUP BY _hash"""),
    "f17_count_by_ingest": _norm("SELECT ingest_id, count(*) AS points FROM norm WHERE error IS NULL GROUP BY ALL"),
    "f18_ingest_stats": _norm("""
SELECT ingest_id, count(*) AS read, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS rejected, CASE WHEN count(*) FILTER (error IS NOT NULL) = 0 THEN 'succeeded' ELSE 'partial' END AS status
FROM norm GROUP BY ALL"""),
    "f19_job_status": _norm("""
SELECT ingest_id, count(*) AS read, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS rejected, CASE WHEN count(*) FILTER (error IS NOT NULL) = 0 THEN 'succeeded' ELSE 'partial' END AS status, count(*) FILTER (error IS NULL AND hdop > 2) AS points
FROM norm GROUP BY ingest_id"""),
    "d04_error_sample": _norm("SELECT seq_no AS idx, error AS message FROM norm WHERE error IS NOT NULL ORDER BY seq_no LIMIT 10"),
    "i02_json_props": "SELECT event_type, sum((props->>'k')::INTEGER)::BIGINT AS sum_k, count(props->>'k') AS n FROM events GROUP BY ALL",
    "b06_stop_props_export": _merge(f"""
SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lng, (SELECT strftime(min(ts), '%Y-%m-%d') FROM gps
WHERE "dateNum" = {_DAY}) || 'T' || time AS time, "truckId" AS truckid, duration_min::VARCHAR AS duration, NULL::VARCHAR AS address FROM props
WHERE "dateNum" = {_DAY} AND {_dist('lat', 'lon', *_CITY)} < 60::DOUBLE"""),
    "b08_csv_lines": _gps("SELECT seq, \"truckId\" || ',' || \"dateNum\" || ',' || time || chr(10) AS line FROM gps"),
    "x01_distance_rollup": _seg(f"SELECT {_KEY}, round({_KM}, 4) AS distance_km FROM seg GROUP BY ROLLUP ({_KEY})"),
    "x02_trips": _gps("""
SELECT "truckId", epoch(date_trunc('second', min(ts)))::BIGINT AS start, count(*) AS points
FROM (SELECT *, sum(new) OVER (PARTITION BY "truckId" ORDER BY ts, seq) AS trip
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY "truckId" ORDER BY ts, seq) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM gps))
GROUP BY "truckId", trip"""),
    "b05_stops_export": _merge("SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lng, NULL::VARCHAR AS address FROM stops"),
    "b07_truck_day_export": _merge(f"""
SELECT "truckId" AS truckid, "dateNum" AS datenum, round(lat, 9) AS lat, round(lon, 9) AS lng, NULL::VARCHAR AS address, '1900-01-01T' || time AS time, duration_min::VARCHAR AS duration
FROM (SELECT *, row_number() OVER (PARTITION BY "stopPropId" ORDER BY id) AS f FROM props WHERE "truckId" = '{_TRUCK}' AND "dateNum" = {_DAY})
WHERE f = 1 AND {_dist('lat', 'lon', *_CITY)} < 60::DOUBLE"""),
    "e11_stop_statistics": _merge(f"""
SELECT p.id, s.id AS stop_id, p."dateNum", p.time, p.duration_min, round(s.lat, 9) AS stop_lat, round(s.lon, 9) AS stop_lon
FROM props p JOIN stops s ON s.id = p."stopPropId" WHERE p."truckId" = '{_TRUCK}'"""),
    "c05_props_of_truck_day": _merge(f"SELECT id, \"stopPropId\", time FROM props WHERE \"truckId\" = '{_TRUCK}' AND \"dateNum\" = {_DAY}"),
    "f20_availability_report": _gps('SELECT "dateNum", ' + ", ".join(f"bool_or(\"truckId\" = 'DEV-{i}') AS \"DEV-{i}\"" for i in range(10)) + ' FROM gps GROUP BY "dateNum"'),
    "c01_matching": _gps(f"SELECT seq, time FROM gps WHERE \"truckId\" = '{_TRUCK}' AND \"dateNum\" = {_DAY}"),
    "c13_latest_by_id": _gps('SELECT "truckId", max(seq) AS seq, arg_max(time, seq) AS time FROM gps GROUP BY "truckId"'),
    "d02_extreme": _gps("""SELECT max(velocity) AS velocity, 'max' AS which FROM gps
UNION ALL SELECT min(v), 'min' FROM (SELECT max(velocity) AS v FROM gps GROUP BY "truckId")"""),
    "h03_degrees": "SELECT event_id, round(value / 100000::DOUBLE, 9) AS degrees, round((event_id * 123456780)::DOUBLE / 1e10::DOUBLE, 9) AS unpacked FROM events",
    "h10_serials": """
WITH s AS (SELECT event_id, to_microseconds(((40000 + event_id % 4000) * 4 + event_id % 4) * 21600000000) AS i, ts FROM events)
SELECT event_id, strftime(TIMESTAMP '1899-12-30' + i, '%Y-%m-%dT%H:%M:%S') AS time, strftime(TIMESTAMP '1900-01-01' + i, '%Y-%m-%dT%H:%M:%S') AS late, ts::DATE AS day FROM s""",
    "h17_time_range": """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'is before 1970-01-01' WHEN event_id % 7 = 0 THEN 'is more than 2 days in the future' END AS fault FROM events""",
    "h22_multimap": _gps(f"""
SELECT "truckId", (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT "dateNum" AS d FROM gps h WHERE h."truckId" = g."truckId")) AS days,
       count(*) FILTER ("dateNum" = {_DAY}) AS on_day, -1::BIGINT AS never
FROM gps g GROUP BY "truckId\""""),
    "i02_canonical_json": """
SELECT event_id, '{"event":"' || event_id || '","kind":"' || event_type || '","user":"' || user_id || '"}' AS json FROM events""",
    **{name: "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events" for name in ("a03_csv", "a04_json", "a06_parquet")},
    "l11_file_ingest": _norm("""
SELECT CASE WHEN count(error) > 0 THEN 'partial' ELSE 'succeeded' END AS status, count(*) AS read, count(*) FILTER (error IS NULL) AS accepted, count(error) AS rejected,
       count(DISTINCT _hash) FILTER (error IS NULL) AS stored, (SELECT count(*) FROM (SELECT arg_max(spike OR turned OR vague, seq_no) AS f FROM norm WHERE error IS NULL GROUP BY _hash) WHERE f) AS flagged
FROM norm"""),
}
