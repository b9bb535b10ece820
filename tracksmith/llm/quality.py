"""A quality classifier of learned subword embeddings.

Words, pairs of neighbouring words and n-grams of characters (white space is one too) are hashed into buckets, each with a learned vector. A
document is the average of its vectors; a softmax layer gives its classes' probabilities. A pair of two equal words
has one bucket of its own, whatever the word. Vectors and layer are trained together by stochastic gradient descent
with numpy on a bounded sample of the labelled rows (Settings.most, most_buckets). As both layers are linear, scoring needs one number a bucket.

Defined cases: a null text counts as empty; a text without features is scored by the layer's bias alone; without
labelled rows, or with one class only, the score is that class's smoothed share; labels that are null, or of rows
outside the table, are not used; repeated rows are scored each, and count as often in training as they stand there;
texts of any length are read whole; an empty table gives no rows; scores() keeps all columns as they are, and adds
its own under the first free name like `name`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import fresh, saved, slices


#: Bytes of text whose features are made at once: about 100 bytes of arrays for each. Bytes of the sample that the driver's JVM gets at once.
RUN_BYTES, SLICE_BYTES = 1 << 18, 1 << 21


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (3, 4)
    size: int = 8
    epochs: int = 8
    batch: int = 16
    #: Steps at the start, falling to zero: a document's average spreads its slope thinly over many vectors, so theirs is large.
    vector_rate: float = 300.0
    layer_rate: float = 1.0
    bias_rate: float = 0.1
    #: Labelled documents of each class that training takes at most, by the order of a hash of their ids, and the buckets that all of them may have.
    most: int = 1500
    most_buckets: int = 8_000_000
    seed: int = 42


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket: its vector's share in the difference of the two classes
    bias: float


def features(run: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts."""
    w = hashing.words(run)
    near = w.text[1:] == w.text[:-1]
    a, b = w.hash[:-1][near], w.hash[1:][near]
    pair = np.where(a == b, np.uint64(0xE0A1), hashing.mix(a * np.uint64(3) + b))
    texts, found = [w.text, w.text[1:][near]], [w.hash, pair]
    for n in s.grams:
        h, at = hashing.grams(w, n)
        texts.append(at)
        found.append(h)
    return np.concatenate(texts), (np.concatenate(found) & np.uint64(s.buckets - 1)).astype(np.int64)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, s: Settings) -> Model:
    """docs: buckets and their shares of each document; weight: how many documents each one stands for."""
    if not len(labels) or labels.min() == labels.max():
        share = (float(np.dot(labels, weight)) + 1) / (float(weight.sum()) + 2)
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.size, 1 / s.size, (s.buckets, s.size)).astype(np.float32)
    layer, bias = np.zeros((s.size, 2), np.float32), np.zeros(2, np.float32)
    weight = weight / weight.mean()
    for epoch in range(s.epochs):
        order = rng.permutation(len(docs))
        fall = 1 - epoch / s.epochs
        for i in range(0, len(order), s.batch):
            pick = [k for k in order[i : i + s.batch] if len(docs[k][0])]
            if not pick:
                continue
            sizes = [len(docs[k][0]) for k in pick]
            at, share = np.concatenate([docs[k][0] for k in pick]).astype(np.int64), np.concatenate([docs[k][1] for k in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[at] * share[:, None], starts, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            slope = p * (weight[pick] / len(pick))[:, None].astype(np.float32)
            back = np.repeat(slope @ layer.T, sizes, axis=0) * share[:, None]
            layer -= fall * s.layer_rate * (mean.T @ slope)
            bias -= fall * s.bias_rate * slope.sum(axis=0)
            used, where = np.unique(at, return_inverse=True)
            step = np.stack([np.bincount(where, back[:, k], len(used)) for k in range(s.size)], 1)
            vectors[used] -= (fall * s.vector_rate * step).astype(np.float32)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(run: list[bytes], model: Model, s: Settings) -> np.ndarray:
    text, bucket = features(run, s)
    total, n = np.bincount(text, model.weights[bucket], len(run)), np.bincount(text, minlength=len(run))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, s: Settings = Settings(), text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Trains on labelled rows of docs; usable: a condition on labels' rows that may be learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.lit(True) if usable is None else usable))
    known = known.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.md5(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")))
    parts = [known.where(F.col("label") == c).orderBy(order, "id").limit(s.most) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).distinct())  # 2 * s.most rows at most

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, run in slices(batch.text, RUN_BYTES):
                of, bucket = features(run, s)
                both, n = np.unique(of * s.buckets + bucket, return_counts=True)
                ends = np.searchsorted(both, (np.arange(len(run) + 1)) * s.buckets)
                rows = [((both[a:b] % s.buckets).astype("<u4").tobytes(), (n[a:b] / max(n[a:b].sum(), 1)).astype("<f4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pd.DataFrame(rows, columns=["at", "share"]).assign(id=batch.id.iloc[start : start + len(run)].to_numpy(), label=batch.label.iloc[start : start + len(run)].to_numpy())[["id", "label", "at", "share"]]

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")
    # An id may stand in the table many times: the bound holds for rows, and for what they weigh, again.
    places = rows.select("id", "label", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    bounded = [places.where(F.col("label") == c).orderBy(order, "id", "digest").limit(s.most) for c in (0, 1)]
    made = saved(bounded[0].unionByName(bounded[1]).mapInPandas(hashed, "id " + dict(docs.dtypes)[key] + ", label int, at binary, share binary"))
    weights = made.select("label", order.alias("order"), "id", "at", "share", (F.octet_length("at") / 4).alias("n"))
    heavy = Window.partitionBy("label").orderBy("order", "id", "at").rowsBetween(Window.unboundedPreceding, -1)  # s.most rows at most
    light = weights.withColumn("before", F.coalesce(F.sum("n").over(heavy), F.lit(0.0))).where(F.col("before") < s.most_buckets / 2)
    # The driver's JVM gets a slice of the sample at a time; a bucket takes 8 bytes.
    sliced = light.select("id", "label", "at", "share").repartition(max(1, math.ceil(8 * s.most_buckets / SLICE_BYTES)))
    found = sorted((r.id, r.label, bytes(r["at"]), bytes(r.share)) for r in sliced.toLocalIterator())
    pairs = [(np.frombuffer(a, "<u4"), np.frombuffer(x, "<f4")) for _, _, a, x in found]
    y = np.array([label for _, label, _, _ in found], np.int64)
    took = np.maximum(np.bincount(y, minlength=2), 1) if len(y) else np.ones(2)
    stands = np.array([sizes.get(0, 0), sizes.get(1, 0)]) / took
    return train(pairs, y, stands[y] if len(y) else np.zeros(0), s)


def scores(docs: DataFrame, model: Model, s: Settings = Settings(), text: str = "text", name: str = "score") -> DataFrame:
    """docs with a further double column, the probability of label 1; fresh(docs, name) tells its name."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(score(run, held.value, s) for _, run in slices(batch, RUN_BYTES))]))

    return docs.withColumn(fresh(docs, name)[0], of(F.col(text).cast("string")))
