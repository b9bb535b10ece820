"""SimHash near-duplicates by anchor-point covering.

Each half of a fingerprint (31 of its 32 bits) is covered by the words of the perfect Hamming code of length 31:
every value lies within distance 1, the covering radius, of one code word, its home. Two fingerprints that differ
in 3 bits or fewer differ in at most 1 bit in one of their halves. So each fingerprint goes to every anchor within
1 + 1 of either half, 16 at most, and meets there every partner that is at home; at each anchor the whole 64
bits are compared. Only distinct fingerprints take part, so copies cost nothing, and an anchor gives a spanning
forest of its links, not all pairs. Crowded anchors are compared block by block.

Defined cases: a null or empty text has the fingerprint zero and is linked like any other; with fewer words than
a shingle has, the whole sequence is the one shingle; repeated rows link to each other; rows of
unlike texts with the same id are told apart; a null id is no component's name unless all of its ids are null; an
empty table gives no rows; other columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import fresh, named, saved, slices, whole

#: Fingerprints of this distance or less are linked; the covering below is built for it.
DISTANCE = 3
#: Fingerprints of an anchor that one task compares with as many.
BLOCK = 4096
_MASKS = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)], np.uint32)
#: For each syndrome, the changes that lead to the code words within 2: none, or one bit and 15 pairs of bits.
_MOVES = np.array([[0] * 16] + [[1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.uint32)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < shingle:
        return hash_of(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
    found = np.array([hash_of(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 4096):
        ones += np.unpackbits(found[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, digest: Column | None = None) -> DataFrame:
    """(id, fp) and, if given, digest: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for _, part in slices(batch.text) for t in part], np.uint64).view(np.int64)
            yield batch.drop(columns="text").assign(fp=found)

    kind = dict(df.dtypes)[key]
    more = [] if digest is None else [digest.alias("digest")]
    # Ids travel as text: pandas makes floats of long columns with nulls, which do not hold every id.
    found = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), *more).mapInPandas(run, "id string, " + ("digest binary, " if more else "") + "fp long")
    return found.withColumn("id", F.col("id").cast(kind))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in fp, anchor, home) of every anchor to which the fingerprints go; bit 31 of an anchor tells the half."""
    out = []
    for half in (0, 1):
        part = (fp >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        syndrome = sum((np.bitwise_count(part & m) & 1).astype(np.int64) << j for j, m in enumerate(_MASKS))
        to = part[:, None] ^ _MOVES[syndrome]
        use = np.ones(to.shape, bool)
        use[syndrome == 0, 1:] = False  # a code word: no other is within 2
        home = np.zeros(to.shape, bool)
        home[:, 0] = True
        place = np.broadcast_to(np.arange(len(fp))[:, None], to.shape)
        out.append((place[use], to[use].astype(np.int64) | half << 31, home[use]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def forest(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links within DISTANCE that join what they can of one anchor's fingerprints; one of each pair is at home."""
    label, out = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= DISTANCE)
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def links_of(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links that join all fingerprints (column fp) which chains of links within DISTANCE join.

    An anchor with more than `block` fingerprints is cut into squares: its home rows in blocks against all its rows in
    blocks, so that no task has more than two blocks of it at once.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 20_000):
                fp = batch.fp.to_numpy(np.int64)[i : i + 20_000]
                place, anchor, home = anchors(fp.view(np.uint64))
                yield pd.DataFrame({"anchor": anchor, "fp": fp[place], "home": home})

    def groups(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
        """Rows sorted by anchor, each anchor whole."""
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
        pairs = [np.zeros((0, 2), np.int64)]
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            pairs.append(np.array(forest(fp[s : s + n], home[s : s + n]), np.int64).reshape(-1, 2) + s)
        size = np.repeat(sizes, sizes)
        for step in range(1, 32):  # the many small groups: each row against the one `step` below it
            i = np.flatnonzero((size[:-step] <= 32) & (size[:-step] > step) & (anchor[:-step] == anchor[step:]))
            if not len(i):
                break
            i = i[(np.bitwise_count(fp[i] ^ fp[i + step]) <= DISTANCE) & (home[i] | home[i + step])]
            pairs.append(np.stack([i, i + step], 1))
        at = np.concatenate(pairs)
        u, v = fp[at[:, 0]].view(np.int64), fp[at[:, 1]].view(np.int64)
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})[u != v].drop_duplicates()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            now = batch if left is None else pd.concat([left, batch])
            a = now.anchor.to_numpy()
            whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            left = now.iloc[whole:]
            if whole:
                yield groups(a[:whole], now.fp.to_numpy(np.int64)[:whole].view(np.uint64), now.home.to_numpy(bool)[:whole])
        if left is not None:
            yield groups(left.anchor.to_numpy(), left.fp.to_numpy(np.int64).view(np.uint64), left.home.to_numpy(bool))

    spread_out = distinct.select("fp").mapInPandas(spread, "anchor long, fp long, home boolean")
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = spread_out.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where(F.col("n") > block)
    crowded = saved(sizes.select("anchor", parts("n").alias("of_all"), parts("h").alias("of_home")))
    few = spread_out.join(crowded, "anchor", "left_anti")
    many = spread_out.join(crowded, "anchor")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    square = F.xxhash64("anchor", "i", "j").alias("anchor")
    homes = many.where("home").select("anchor", "fp", "home", own("of_home").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"))
    guests = many.where("of_home > 0").select("anchor", "fp", F.lit(False).alias("home"), own("of_all").alias("j"), F.explode(F.sequence(F.lit(0), F.col("of_home") - 1)).alias("i"))
    meeting = few.select("anchor", "fp", "home").unionByName(homes.select(square, "fp", "home")).unionByName(guests.select(square, "fp", "home"))
    n = spread_out.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_ = meeting.repartition(int(n), "anchor").sortWithinPartitions("anchor")
    return sorted_.mapInPandas(compare, "u long, v long").distinct()


def components(rows: DataFrame, place: Column) -> DataFrame:
    """(fp, first, n): for every fingerprint of rows, the least `place` that links reach, and its number of rows."""
    nodes = saved(rows.groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("n")))
    roots = connected_components(links_of(nodes))
    of = saved(nodes.join(roots, nodes.fp == roots.node).groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("nodes")))
    linked = named(roots, of, "root", "nodes", roots.count()).select(F.col("node").alias("fp"), "first")
    return saved(nodes.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("first"), "n"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the smallest id that links reach) of every row."""
    rows = saved(fingerprints(df, text, key, shingle))
    found = named(rows, components(rows, F.col("id")), "fp", "n", rows.count())
    return found.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5) -> DataFrame:
    """One row of df for each component: that with the smallest id (null ids come last; of equal ids, the least digest of the text)."""
    mark = F.unhex(F.md5(whole(text)))  # id and digest tell rows apart; rows equal in both are the same text
    rows = saved(fingerprints(df, text, key, shingle, mark))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    placed = named(rows, components(rows, place), "fp", "n", rows.count()).select("id", "digest", (place == F.col("first")).alias("stays"))
    own, digest, gone = fresh(df, "digest__", "gone__", "gone_digest__")
    told = lambda t: t.select(F.col("id").alias(digest), F.col("digest").alias(gone))
    same = F.col(key).eqNullSafe(F.col(digest)) & (F.col(own) == F.col(gone))
    losers = told(placed.where("not stays").distinct())
    again = saved(placed.where("stays").groupBy("id", "digest").count().where("count > 1"))
    left = df.withColumn(own, mark).join(losers, same, "left_anti")
    if not again.isEmpty():  # repeated rows: one of each
        left = left.join(told(again), same, "left_anti").unionByName(left.join(told(again), same, "left_semi").dropDuplicates([key, own]))
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
