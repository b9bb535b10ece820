"""Schemas of the tables, as DDL; parsing one needs a session, so callers do that."""

from __future__ import annotations

TRUCK_POINTS = "truckId string, time string, velocity double, lat double, lon double, dateNum int, patent string, direction string, temperature double, commune string, timestamp string, ts timestamp, seq long"
TRUCKS = "id string, time string, velocity double, dateNum int, patent string, timestamp string"
TRUCK_DATES = "dateNum int, availability map<string,boolean>, routeCenters map<string,struct<lat:double,lon:double>>"
STOPS = "id int, lat double, lon double"
STOP_PROPS = "id int, stopPropId int, truckId string, dateNum int, lat double, lon double, duration_min double, time string, radius double, address string"
TRACK_POINTS = "device_id string, ts_utc timestamp, lat double, lon double, speed_mps double, heading_deg double, alt_m double, hdop double, src string, raw string, ingest_id string, seq_no long, quality_flags map<string,boolean>, loc struct<type:string,coordinates:array<double>>, _hash string"
INGEST_JOBS = "ingest_id string, source string, params map<string,string>, status string, started_at timestamp, finished_at timestamp, stats struct<read:bigint,accepted:bigint,rejected:bigint>, error_sample map<bigint,string>"
RESULT = "accepted long, rejected long, errors map<bigint,string>, ingest_id string"


def columns(ddl: str) -> list[str]:
    """The names of a schema without nested fields."""
    return [field.split()[0] for field in ddl.split(", ")]
