"""Exact inner-product search: a ball tree per shard, searched by branch and bound with shared bounds.

Vectors become whole numbers. Rows are dealt by place: each goes to the nearest of at most PLACES pivots, so that a
place is a ball; a place with more than SHARD rows has several shards. Each shard's task builds a ball tree over its
rows. A node's bound for a query is (query . centre) + |query| * radius; nodes are taken in falling order of their
bounds, and one is skipped for every query whose k-th score so far is higher. A query first searches the shard it
lies in, then other places in rounds, those with the highest bounds first; after each round its k-th score is the
best over all shards so far, and places whose ball cannot reach it are never sent the query. Queries meet shards in
blocks, of at most BLOCK queries and SHARD rows, so a task's memory has a bound.

Defined cases: vectors that are null, or hold nulls or non-finite components, and rows without an id take no part;
rows that share an id are rows of their own: each is a query if the id is one, and a candidate for the others;
vectors of unlike lengths never meet; equal scores go to the smaller id; fewer than k candidates give all of them;
an empty table gives no rows; other columns are ignored. Components beyond 64 bits, and scores beyond, are held at
the ends of the 64-bit range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Most rows of a shard and most queries that it meets at once; rows of a leaf; most places, whose pivots and radii are sent to all tasks.
SHARD, BLOCK, LEAF, PLACES = 1 << 16, 1 << 14, 64, 256
#: Places that a query searches in its first round; each further round takes four times as many.
FIRST_PLACES = 4
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    parts: tuple[Ball, Ball] | None = None


def ball(points: np.ndarray, rows: np.ndarray) -> Ball:
    """A tree of balls around the rows' points, halved along the line between two far points."""
    own = points[rows]
    centre = own.mean(axis=0)
    away = np.linalg.norm(own - centre, axis=1)
    made = Ball(centre, float(away.max()) * (1 + 1e-9), rows)
    if len(rows) > LEAF and made.radius > 0:
        one = own[away.argmax()]
        line = own[np.linalg.norm(own - one, axis=1).argmax()] - one
        order = np.argsort(own @ line, kind="stable")
        half = len(rows) // 2
        made.parts = ball(points, rows[order[:half]]), ball(points, rows[order[half:]])
    return made


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers: in floats while they are exact there, else in Python's numbers."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(a.shape[1], 1) < 2.0**52:
        return (x @ y.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LOW + 1, _HIGH).astype(np.int64)


def search(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best rows among those that reach its bound; _LOW where there are fewer. own: the queries' rows."""
    points, asked = vectors.astype(np.float64), queries.astype(np.float64)
    length = np.linalg.norm(asked, axis=1)
    best, who = np.full((len(queries), k), _LOW, np.int64), np.full((len(queries), k), _HIGH, np.int64)
    floor = bound.astype(np.float64)

    def reach(b: Ball) -> np.ndarray:
        flat = asked @ b.centre
        return flat + length * b.radius + 1 + 1e-9 * np.abs(flat)

    root = ball(points, np.arange(len(ids)))
    heap, n = [(-reach(root).max(), 0, root)], 0
    while heap:
        _, _, node = heapq.heappop(heap)
        live = np.flatnonzero(reach(node) >= floor)  # equal: a tie may go to a smaller id
        if not len(live):
            continue
        if node.parts:
            for part in node.parts:
                n += 1
                heapq.heappush(heap, (-reach(part)[live].max(), n, part))
            continue
        got = products(queries[live], vectors[node.rows])
        new = np.broadcast_to(ids[node.rows], got.shape)
        got = np.where((rows[node.rows] == own[live, None]) | (got < bound[live, None]), _LOW, got)
        scores = np.concatenate([best[live], got], axis=1)
        names = np.concatenate([who[live], np.where(got == _LOW, _HIGH, new)], axis=1)
        order = np.lexsort((names, ~scores), axis=1)[:, :k]
        best[live], who[live] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        floor[live] = np.maximum(floor[live], best[live, -1].astype(np.float64))
    return best, who


def _rows(own: np.ndarray, best: np.ndarray, who: np.ndarray) -> pd.DataFrame:
    use = best > _LOW
    return pd.DataFrame({"query": np.repeat(own, use.sum(axis=1)), "vec_id": who[use], "score": best[use]})


_FOUND = "query long, vec_id long, score long"


def _by_length(a: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    sizes = a.map(len).to_numpy()
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def quantised(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(row, id, v): floor(256 x) of every vector that takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole)
    return used.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).cast("array<bigint>").alias("v"))


@dataclass(frozen=True)
class Places:
    """Pivots of each length of vectors, numbered over all lengths, and the radius of each place."""

    pivots: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: the places' numbers, their pivots
    radius: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance to its pivot) of vectors of one length."""
        number, pivots = self.pivots[vectors.shape[1]]
        points = vectors.astype(np.float64)
        at = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
        return number[at], np.linalg.norm(points - pivots[at], axis=1)

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, the most that any of their rows can score for each query)."""
        number, pivots = self.pivots[queries.shape[1]]
        asked = queries.astype(np.float64)
        flat = asked @ pivots.T
        slack = np.linalg.norm(asked, axis=1)[:, None] * self.radius[number]
        return number, flat + slack * (1 + 1e-9) + 1 + 1e-9 * np.abs(flat)


def deal(rows: DataFrame, places: int) -> tuple[DataFrame, Places]:
    """(row, id, v, place) and the places: pivots are the vectors whose rows come first by a hash, for each length as many as its share of the rows asks for, and one at least."""
    spark = rows.sparkSession
    lengths = {r.n: r.m for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).collect()}  # lengths, not rows
    total, pivots, start = sum(lengths.values()), {}, 0
    for n, m in lengths.items():
        first = rows.where(F.size("v") == n).orderBy(F.xxhash64("row"), "row").select("v").limit(max(1, places * m // total)).collect()  # places at most
        pivots[n] = np.arange(start, start + len(first)), np.unique(np.array([r.v for r in first], np.float64).reshape(len(first), n), axis=0)
        pivots[n] = pivots[n][0][: len(pivots[n][1])], pivots[n][1]
        start += len(first)
    known = spark.sparkContext.broadcast(Places(pivots, np.zeros(start)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for _, at in _by_length(batch.v):
                place[at], away[at] = known.value.nearest(np.stack(batch.v.to_numpy()[at]))
            yield batch.assign(place=place, away=away)

    dealt = saved(rows.mapInPandas(placed, "row long, id long, v array<bigint>, place int, away double"))
    radius = np.zeros(start)
    for r in dealt.groupBy("place").agg(F.max("away").alias("radius")).collect():  # places rows at most
        radius[r.place] = r.radius
    return dealt.drop("away"), Places(pivots, radius)


def top_k(df: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = saved(quantised(df, vector, key))
    n = rows.count()
    size = min(SHARD, max(1024, n // (4 * spark.sparkContext.defaultParallelism)))
    dealt, places = deal(rows, min(PLACES, max(1, -(-n // size))))
    parts = dealt.groupBy("place").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # one row for each place
    shards = saved(dealt.join(F.broadcast(parts), "place").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")))
    held = spark.sparkContext.broadcast(places)
    # In every round each (place, part) meets its queries block by block; a block has BLOCK queries on average.
    blocks = max(1, -(-shards.where(F.pmod("id", F.lit(every)) == 0).count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int")
    targets = shards.select("place", "part", F.col("row").alias("r"), F.col("id").alias("i"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(asked: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        out = [_rows(np.zeros(0, np.int64), np.zeros((0, k), np.int64), np.zeros((0, k), np.int64))]
        lengths = dict(_by_length(batch.w)) if len(batch) else {}
        for length, q in _by_length(asked.v) if len(asked) else ():
            if length in lengths:
                at, own = lengths[length], asked.row.to_numpy()[q]
                out.append(_rows(own, *search(batch.r.to_numpy()[at], batch.i.to_numpy()[at], np.stack(batch.w.to_numpy()[at]), own, np.stack(asked.v.to_numpy()[q]), asked.bound.to_numpy()[q], k)))
        return pd.concat(out)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, best: DataFrame | None) -> DataFrame:
        """The k best so far, with what the asked shards give (k rows of a shard at most)."""
        found = asked.groupBy("place", "part", "block").cogroup(targets.groupBy("place", "part", "block")).applyInPandas(meet, _FOUND)
        ranked = (found if best is None else best.select("query", "vec_id", "score").unionByName(found)).withColumn("rank", F.row_number().over(order))
        return saved(ranked.where(F.col("rank") <= k))

    asks = shards.where(F.pmod("id", F.lit(every)) == 0).select("row", "id", "v", "place", "part", "parts", block.alias("block"))
    best = searched(asks.withColumn("bound", F.lit(_LOW)), None)
    start, width = 0, FIRST_PLACES

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(row, place, rest): the next places that can still matter to each query, and whether there are more."""
        for batch in batches:
            out = [pd.DataFrame({"row": np.zeros(0, np.int64), "to": np.zeros(0, np.int64), "rest": np.zeros(0, bool)})]
            for _, at in _by_length(batch.v):
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    number, reach = held.value.reach(np.stack(batch.v.to_numpy()[part]))
                    order = np.argsort(-reach, axis=1, kind="stable")
                    live = np.take_along_axis(reach, order, 1) >= batch.bound.to_numpy()[part, None].astype(np.float64)
                    q, p = np.nonzero(live[:, start : start + width])
                    out.append(pd.DataFrame({"row": batch.row.to_numpy()[part][q], "to": number[order[q, p + start]], "rest": live[q, min(start + width, live.shape[1] - 1)] & (start + width < live.shape[1])}))
            yield pd.concat(out)

    while True:
        bounds = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_LOW)).alias("bound"))
        current = asks.join(bounds, F.col("row") == F.col("query"), "left").withColumn("bound", F.coalesce("bound", F.lit(_LOW))).drop("query")
        chosen = saved(current.select("row", "v", "bound").mapInPandas(wanted, "row long, to int, rest boolean"))
        counts = chosen.agg(F.count("*"), F.count_if("rest")).first()
        if counts[0]:
            spread = current.withColumnsRenamed({"place": "home", "part": "home_part"}).drop("parts").join(chosen, "row")
            spread = spread.join(F.broadcast(parts), spread["to"] == parts["place"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            spread = spread.where((F.col("to") != F.col("home")) | (F.col("part") != F.col("home_part")))
            best = searched(spread.select("row", "v", "bound", F.col("to").alias("place"), "part", "block"), best)
        if not counts[1]:
            break
        start, width = start + width, width * 4
    named = best.join(asks.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
