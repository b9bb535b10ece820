"""Ranked lexical search by presence masks.

Each text is read once into postings: its number of terms, and the places and counts of those that some item asks
for. A task then takes postings block by block. In a block every term has a bitmap of the documents that hold it;
an item's bitmaps, turned over, give each document the mask of the item's terms that it holds, and documents with
the same mask form a group. A mask's documents score at most the sum of its terms' highest parts in the block, so
masks are taken in descending order of that sum until it falls below the item's k-th score. Each task hands on k
documents an item, and a window takes the best of these.

Items are taken in blocks of about ITEM_BYTES of text, so what a task holds of them is bounded; each block reads the
documents once.

Defined cases: a null text and one without terms take part in no count and no result; an item without terms has no
rows; texts of any length are read whole, a run of bytes at a time; documents that share an id rank each on its
own, and of equal scores the smaller id comes first, a null id last; items repeated whole count once, and items
with the same id and unlike texts are ranked each on its own; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rounds, saved, whole

#: Bytes of items' text that one pass over the documents serves; cells (terms by documents) of a block.
ITEM_BYTES, CELLS = 1 << 19, 1 << 22
#: Bytes of a text that are split into terms at once.
RUN = 1 << 20
_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LAST = (1 << 63) - 1


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in runs: digits, letters and whatever is beyond ASCII, A-Z in lower case."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM) if isinstance(text, str) else b""
    begin = 0
    while begin < len(data):
        end = len(data) if len(data) - begin <= RUN else data.find(b" ", begin + RUN)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def counted(text: str | None, known: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms the text has, and the numbers and counts of the known ones."""
    n, counts = 0, Counter()
    for run in terms(text):
        n += len(run)
        counts.update(run)
    if len(counts) > len(known):
        found = [(i, counts[t]) for t, i in known.items() if t in counts]
    else:
        found = [(known[t], c) for t, c in counts.items() if t in known]
    both = np.array(found, np.int64).reshape(-1, 2)
    return n, both[:, 0].astype(np.int32), both[:, 1]


def groups(bitmaps: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, of): the distinct columns of packed bitmaps (a row for each term), as packed bytes, and each document's number among them."""
    turned = np.packbits(np.unpackbits(bitmaps, axis=1, count=docs).T, axis=1)
    masks, of = np.unique(np.ascontiguousarray(turned).view(f"V{turned.shape[1]}").ravel(), return_inverse=True)
    return masks.view(np.uint8).reshape(len(masks), -1), of


class Best:
    """The k best (score, place, null id) of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def least(self) -> int:
        """A score below this cannot come in; one that is equal can, by its id."""
        return max(1, int(self.rows[-1, 0])) if len(self.rows) == self.k else 1

    def take(self, score: np.ndarray, place: np.ndarray, null: np.ndarray) -> None:
        use = score >= self.least
        rows = np.concatenate([self.rows, np.stack([score[use], place[use], null[use]], 1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def evaluated(bitmaps: np.ndarray, parts: np.ndarray, place: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Takes a block's documents into `best`; parts: what each of the item's terms (rows) adds to each document's score. Returns how many masks were looked at."""
    masks, of = groups(bitmaps, len(place))
    held = np.unpackbits(masks, axis=1, count=len(parts)).astype(np.int64)
    most = held @ parts.max(axis=1)
    order = np.argsort(-most, kind="stable")
    members = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(masks)))
    begins = ends - np.bincount(of, minlength=len(masks))
    at, step = 0, 8
    while at < len(order) and most[order[at]] >= best.least:
        now = order[at : at + step]
        now = now[most[now] >= best.least]
        docs = np.concatenate([members[begins[g] : ends[g]] for g in now])
        best.take(parts[:, docs].sum(axis=0), place[docs], null[docs])
        at, step = at + step, step * 2
    return min(at, len(order))


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """item_key, rank, key and score of each item's k documents with the highest score above 0."""
    asked = saved(items.select(F.col(item_key).alias("item"), whole(item_text).alias("said")).distinct())
    size = asked.agg(F.sum(F.octet_length("said") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    steps = Rounds(docs.sparkSession)
    try:
        found = [_block(docs, asked.where(F.pmod(F.xxhash64("said"), F.lit(blocks)) == b), k, text, key, steps).withColumn("block", F.lit(b)) for b in range(blocks)]
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        order = Window.partitionBy("block", "number").orderBy(F.desc("score"), "place", "null")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kind = dict(docs.dtypes)[key]
        return saved(ranked.select(F.col("item").alias(item_key), "rank", F.when(F.col("null") == 0, F.col("place")).cast(kind).alias(key), "score"))
    finally:
        steps.close()


def _block(docs: DataFrame, asked: DataFrame, k: int, text: str, key: str, steps: Rounds) -> DataFrame:
    """item, number, place, null, score: each task's k best of every item of one block."""
    spark = docs.sparkSession
    rows = asked.collect()  # about ITEM_BYTES of text, or one item
    known: dict[bytes, int] = {}
    wanted: list[tuple[int, np.ndarray, np.ndarray]] = []
    for number, row in enumerate(rows):
        own = Counter(t for run in terms(row.said) for t in run)
        if own:
            wanted.append((number, np.array([known.setdefault(t, len(known)) for t in own]), np.array(list(own.values()), np.int64)))
    sent = spark.sparkContext.broadcast((known, wanted))  # the block's terms

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = sent.value[0]
        for batch in batches:
            got = [counted(t, numbers) for t in batch.said]
            yield pd.DataFrame({"place": batch.place, "null": batch.null, "n": [g[0] for g in got], "terms": [g[1].tobytes() for g in got], "counts": [g[2].tobytes() for g in got]})

    place = F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("place")
    posted = docs.select(place, F.col(key).isNull().cast("int").alias("null"), F.col(text).cast("string").alias("said"))
    postings = steps.keep(posted.mapInPandas(read, "place long, null int, n long, terms binary, counts binary").where("n > 0"))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(sent.value[0]), np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.terms), np.int32), minlength=len(df))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    total, length = postings.agg(F.count("*"), F.sum("n")).first()
    weight = np.zeros(len(known), np.int64)
    for term, df in postings.select("terms").mapInPandas(held, "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # the block's terms
        weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    weights = spark.sparkContext.broadcast(weight)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, best = sent.value[1], {}
        width = len(sent.value[0])
        step = max(8, min(4096, CELLS // max(width, 1)) // 8 * 8)
        for batch in batches:
            for i in range(0, len(batch), step):
                run = batch.iloc[i : i + step]
                sizes = np.array([len(x) // 4 for x in run.terms], np.int64)
                term, tf = np.frombuffer(b"".join(run.terms), np.int32), np.frombuffer(b"".join(run.counts), np.int64)
                doc = np.repeat(np.arange(len(run)), sizes)
                m = 25 + np.array([75 * n * total // length for n in run.n.tolist()], np.int64)
                parts = np.zeros((width, len(run)), np.int64)
                parts[term, doc] = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                bits = np.zeros((width, len(run)), bool)
                bits[term, doc] = True
                bitmaps = np.packbits(bits, axis=1)
                places, null = run.place.to_numpy(np.int64), run.null.to_numpy(np.int64)
                for number, of, times in wanted:
                    evaluated(bitmaps[of], parts[of] * times[:, None], places, null, best.setdefault(number, Best(k)))
        found = [(n, *row) for n, b in best.items() for row in b.rows.tolist()]
        yield pd.DataFrame(found, columns=["number", "score", "place", "null"])

    best = postings.mapInPandas(score, "number int, score long, place long, null int")
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number int, item {dict(asked.dtypes)['item']}")
    return steps.keep(best.join(F.broadcast(names), "number"))  # a row for each item of the block
