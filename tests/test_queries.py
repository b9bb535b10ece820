from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tracksmith import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", ["f02_total_distance", "f06_segment_speed", "e05_route_centers", "l01_stops", "l03_stop_props", "f15_schedule", "g01_long_dwell", "h15_validation", "h13_point_hash", "b11_dedup_upsert", "h22_multimap", "a03_csv", "l11_file_ingest", "b07_truck_day_export"])
def test_spark_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    frame = core.QUERIES[name](spark, SF)
    found = con.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_core_query_has_sql():
    assert set(core.ORACLES) == set(core.QUERIES)
