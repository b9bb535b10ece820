"""Tables in the order of place, lookups by Bloom filters, and the nearest places against a plain search."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.helpers import km
from tracksmith.functions.geo import near, within_box
from tracksmith.operators import lookups, places
from tracksmith.operators.store import Store


def rows_read(df):
    """What the scan of a plan without exchanges gave on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def found(df, *columns):
    return {tuple(r[c] for c in columns): [(e[0], round(e[1], 5)) for e in r["nearest"]] for r in df.collect()}


def plain(asked, known, k):
    return [(n, round(d, 5)) for d, n in sorted((km(a, (lat, lon)), n) for a in [asked] for n, lat, lon in known)[:k]]


def test_nearest_is_a_plain_search(spark):
    at = random.Random(5)
    known = [(i, at.uniform(-1, 1) * 0.2, at.uniform(-1, 1) * 0.2) for i in range(300)]  # a town
    known += [(1000 + i, at.uniform(-89, 89), at.uniform(-180, 180)) for i in range(60)]  # and the world
    known += [(2000, 90.0, 0.0), (2001, -90.0, 10.0), (2002, 10.0, 180.0), (2003, 10.0, -179.9999)]
    asked = [(at.uniform(-90, 90), at.uniform(-180, 180)) for _ in range(60)] + [(at.uniform(-1, 1) * 0.3, at.uniform(-1, 1) * 0.3) for _ in range(40)]
    asked += [(90.0, 50.0), (-89.9, 0.0), (10.0, 179.99995), (0.0, -0.0)]
    where = spark.createDataFrame(known, "place long, lat double, lon double")
    for k in (1, 4):
        got = found(places.nearest(spark.createDataFrame(asked, "lat double, lon double"), where, k, "place"), "lat", "lon")
        assert len(got) == len(asked)
        for a in asked:
            assert got[a] == plain(a, known, k)


def test_many_places_at_a_point_and_ties(spark):
    known = spark.range(3000).select(F.col("id").alias("place"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon")).unionByName(spark.createDataFrame([(-1, 10.0, 20.5)], "place long, lat double, lon double"))
    asked = spark.range(500).select("id", F.lit(10.0).alias("lat"), F.lit(20.2).alias("lon"))
    got = found(places.nearest(asked, known, 3, "place"), "id")
    assert len(got) == 500 and all([n for n, _ in v] == [0, 1, 2] for v in got.values())
    few = places.nearest(asked.limit(1), known.where("place in (-1, 7)"), 3, "place")
    assert [[e["place"] for e in r["nearest"]] for r in few.collect()] == [[7, -1]]


def test_rows_and_places_that_are_nowhere(spark):
    known = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, None)], "place long, lat double, lon double")
    asked = spark.createDataFrame([(1, 1.0, 2.0, "x"), (1, 1.0, 2.0, "x"), (2, None, 2.0, None), (3, float("nan"), 1.0, "y")], "id long, lat double, lon double, nearest string")
    got = sorted((r["id"], [e["place"] for e in r["nearest"]]) for r in places.nearest(asked, known, 2, "place").collect())
    assert got == [(1, [1]), (1, [1]), (2, []), (3, [])]
    none = places.nearest(asked, known.limit(0), 2, "place")
    assert none.columns == ["id", "lat", "lon", "nearest"] and all(r["nearest"] == [] for r in none.collect())
    assert places.nearest(asked.limit(0), known, 2, "place").count() == 0


def test_a_table_by_place_is_read_in_part(spark, tmp_path):
    n = 60_000
    points = spark.range(n).select(F.col("id").alias("seq"), (F.rand(1) * 10).alias("lat"), (F.rand(2) * 10).alias("lon")).repartition(6)
    store = Store(spark, f"file://{tmp_path}", options={"parquet.block.size": str(16 << 10), "parquet.page.size": "4096"})
    store.overwrite("plain", points)
    store.overwrite("placed", places.by_place(points, then=["seq"]))
    placed, loose = store.read("placed"), store.read("plain")
    assert placed.count() == n
    assert sum(pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("placed/*/*/*/*.parquet")) > 40
    box = within_box(4.0, 4.5, 7.0, 7.5)
    assert sorted(placed.where(box).collect()) == sorted(loose.where(box).select(placed.columns).collect())
    assert rows_read(placed.where(box)) < n / 8 < rows_read(loose.where(box))
    close = near(placed, 4.2, 7.2, 20_000.0)
    assert sorted(r.seq for r in close.collect()) == sorted(r.seq for r in near(loose, 4.2, 7.2, 20_000.0).collect())


def test_few_hashes_are_told_by_bloom_filters(spark, tmp_path):
    n = 40_000
    points = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("_hash"), "id").repartition(8)
    store = Store(spark, f"file://{tmp_path}", options={"parquet.block.size": str(64 << 10)})
    store.overwrite("points", points)
    stored = store.read("points")
    few = [r[0] for r in points.where("id in (5, 17)").select("_hash").collect()]
    assert rows_read(stored.select("_hash").where(F.col("_hash").isin(few))) < n / 4
    assert rows_read(stored.select("_hash").where(F.col("_hash").isin([*few, *map(str, range(20))]))) < n / 2
    asked = spark.range(-3, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("_hash"), F.lit(1).alias("more"))
    asked = asked.unionByName(asked).unionByName(spark.createDataFrame([(None, 1)], "_hash string, more int"))
    for most in (1000, 3):
        assert sorted(lookups.existing_few(asked, stored, most=most).collect()) == sorted(lookups.existing(asked, stored).collect())
    assert lookups.existing_few(asked, stored).count() == 12
    assert lookups.existing_few(asked.limit(0), stored).count() == 0
