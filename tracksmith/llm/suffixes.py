"""Removal of passages that stand more than once, by sorting suffixes block by block with a difference cover.

A byte goes if some string of `length` bytes that covers it starts anywhere else. Positions of a text whose place
modulo PERIOD lies in the cover COVER are samples; for any two positions there is a shift below PERIOD that takes
both to samples. So equal strings of `length` bytes hold equal sample windows (length - PERIOD + 1 bytes) at the
shift of their two places, and two strings are equal if they agree in the PERIOD - 1 first and last bytes and in the
sample windows at that shift.

1. Samples' windows are named: equal windows get equal names, and those that stand once get none. Names do the work
   of ranks, as only equality is asked; they are 64 bits wide. Where the PERIOD - 1 bytes behind two equal windows
   agree too, the samples are repeated suffixes themselves, and the bytes that these cover are settled.
2. What such suffixes do not cover is asked for: a bitmap of at most FILTER_BITS bits tells the names, and how far
   before their samples suffixes begin, in STEPS, that may cover more. Only suffixes there take part, in all texts.
   Where the bitmap errs, more of them do; results do not depend on it.
3. Suffixes are sorted one bucket at a time: a bucket is told by the first 8 bytes and there are ROUNDS of them, each
   dealt out and settled by its own job. They are sorted by 128 bits of their outer bytes, and ties, which may be
   long, are settled by the names at the shift of each two places.
4. Repeated suffixes come back to their texts, as runs of bytes that go.

Texts are told by SHA-256; of equal ones, one takes part. What stands twice within a slice that one task reads is
settled there, and one of its suffixes is sent on for all, so a passage that many texts share sends one row for each
slice. Names decide only between strings that agree in their outer bytes already.

Defined cases: a null text counts as empty; texts below `length` bytes lose nothing; texts of any length are read
whole, BLOCK bytes at a time; texts equal to another one, of `length` bytes or more, go whole, whatever rows hold
them; bytes are judged on the input, and a cut may fall inside a character, so what is left is binary; null and
repeated ids are rows like others; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, fresh, named, power_of_two, saved, whole
from .hashing import mix
from .lm import CLEANUP

#: Bytes that a repeated string has.
LENGTH = 400
#: Buckets of samples and of suffixes; suffixes that a task settles before it sends them on; bytes of a text looked at at once; bytes of text for each part of a bucket.
NAME_ROUNDS, ROUNDS, BATCH, BLOCK, PART_BYTES = 3, 2, 1 << 16, 1 << 20, 16 << 20
#: Kinds of strings with the same key that are told one by one.
KINDS = 64
#: Bits of the bitmap at most, and bytes of text for each of them in smaller tables.
FILTER_BITS, BIT_BYTES = 1 << 28, 32


def cover(r: int) -> tuple[int, np.ndarray]:
    """A difference cover by its rule of steps (Colbourn and Ling): its period and its 6 r + 4 places."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


PERIOD, COVER = cover(1)
_IN = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
_ORDER = np.cumsum(_IN[:PERIOD]) - 1  # a sample's number within its period
#: For each place, the shifts below PERIOD that lead to samples; for two places, which of the first one's shifts leads both to samples.
SHIFTS = np.array([np.flatnonzero(_IN[a : a + PERIOD]) for a in range(PERIOD)])
SLOTS = np.array([[int(np.flatnonzero(np.isin(SHIFTS[a], SHIFTS[b]))[0]) for b in range(PERIOD)] for a in range(PERIOD)])
#: The number of a place's samples, by shift, counted from the first of its period; so names stand in one array, a text's samples in a row.
NUMBERS = np.array([(a + SHIFTS[a]) // PERIOD * len(COVER) + _ORDER[(a + SHIFTS[a]) % PERIOD] for a in range(PERIOD)])
#: Where the steps begin and end in which shifts are asked for.
STEPS = np.array([0, 19, 38, 57, PERIOD])
_ROWS = "part int, known boolean, hi binary, lo binary, row binary, off binary, names binary"
#: Sorted by, where, and whose: keys of 64 bits each, places in a text, where each place's names begin, the names, and each place's text.
Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_FOUND = "part int, row binary, off binary, names binary, sure binary"


def alike(place: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the strings that agree in their outer bytes stand twice; place: modulo PERIOD; names: at the shifts of the place, 0: none."""
    out, kinds = np.zeros(len(place), bool), np.unique(place)
    for i, a in enumerate(kinds):
        mine = np.flatnonzero(place == a)
        own = names[mine, SLOTS[a, a]]
        _, back, n = np.unique(own, return_inverse=True, return_counts=True)
        out[mine] |= (n[back] > 1) & (own != 0)
        for b in kinds[i + 1 :]:
            others = np.flatnonzero(place == b)
            p, q = names[mine, SLOTS[a, b]], names[others, SLOTS[b, a]]
            out[mine] |= np.isin(p, q) & (p != 0)
            out[others] |= np.isin(q, p) & (q != 0)
    return out


def settled(hi: np.ndarray, lo: np.ndarray, place: np.ndarray, name: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, sent): which rows stand twice among these, and which must be held against others: of equal ones at least one.

    place: modulo PERIOD; name(rows, slots): names of rows at those of their shifts, None where equal hi is enough.
    """
    n = len(hi)
    repeated, sent = np.zeros(n, bool), np.ones(n, bool)
    if not n:
        return repeated, sent
    order = np.argsort(hi)
    new = np.concatenate([[True], hi[order][1:] != hi[order][:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(first, n))
    same = np.ones(n, bool)
    if name is not None:
        some = np.flatnonzero(~new)
        lead, row = order[first][group[some]], order[some]
        mine = name(row, SLOTS[place[row], place[lead]])
        same[some] = (lo[lead] == lo[row]) & (name(lead, SLOTS[place[lead], place[row]]) == mine) & (mine != 0)
    mates = np.bincount(group[same], minlength=len(size))
    repeated[order] = same & (mates[group] > 1)
    sent[order] = ~same | new
    for g in np.flatnonzero(mates < size):
        own = order[first[g] : first[g] + size[g]][~same[first[g] : first[g] + size[g]]]
        for _ in range(KINDS):  # those that the first one equals go, if there are few kinds
            if not len(own):
                break
            mine = name(own, SLOTS[place[own], place[own[0]]])
            equal = (lo[own] == lo[own[0]]) & (mine == name(own[:1], SLOTS[place[own[0]], place[own]])) & (mine != 0)
            equal[0] = True
            repeated[own[equal]] = equal.sum() > 1
            sent[own[equal][1:]] = False
            own = own[~equal]
        for low in np.unique(lo[own]):
            tied = own[lo[own] == low]
            repeated[tied] |= alike(place[tied], name(tied[:, None], np.arange(len(COVER))[None, :]))
    return repeated, sent


def twins(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alike, sure, sent): which samples have a window that stands twice among these; which have the bytes behind it in common too (lo, 0: none); and which must be held against others: of equal ones one."""
    n = len(hi)
    alike_, sure, sent = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
    if not n:
        return alike_, sure, sent
    order = np.argsort(hi)
    tie = hi[order][1:] == hi[order][:-1]
    alike_[order[1:][tie]] = True
    alike_[order[:-1][tie]] = True
    some = np.flatnonzero(alike_)
    some = some[np.lexsort((lo[some], hi[some]))]
    tie = (hi[some][1:] == hi[some][:-1]) & (lo[some][1:] == lo[some][:-1])
    sent[some[1:][tie]] = False
    tie &= lo[some][1:] != 0
    sure[some[1:][tie]] = True
    sure[some[:-1][tie]] = True
    return alike_, sure, sent


def words(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n words of 8 bytes that begin at each place, as numbers."""
    return sliding_window_view(data, 8 * n)[at].view("<u8") if len(at) else np.zeros((0, n), np.uint64)


def hashed(w: np.ndarray) -> np.ndarray:
    """64 bits of each row of words."""
    x = np.full(len(w), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(w.shape[1]):
        x = (x ^ w[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return mix(x)


def samples(data: bytes, at: np.ndarray, ends: np.ndarray, length: int, rounds: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, hi, lo) of the sample windows in a bucket, of those that begin at these places of the joined texts; ends: where the texts of these end; lo is 0 where no string of `length` bytes begins."""
    from xxhash import xxh3_64_digest

    size, edge, view = length - PERIOD + 1, PERIOD - 1, np.frombuffer(data, np.uint8)
    which = np.flatnonzero(mix(words(view, at, 1)[:, 0]) % np.uint64(rounds) == bucket)
    at, ends = at[which], ends[which]
    hi = np.frombuffer(b"".join([xxh3_64_digest(data[p : p + size]) for p in at.tolist()]), ">u8").astype(np.uint64)
    hi[hi == 0] = 1  # 0 is no name
    lo, more = np.zeros(len(at), np.uint64), np.flatnonzero(at + length <= ends)
    lo[more] = np.maximum(hashed(words(view, at[more] + size, edge // 8)), np.uint64(1))
    return which, hi, lo


def sampled(rows: Iterator[tuple[int, bytes]], length: int, rounds: int, bucket: int) -> Iterator[Part]:
    """The parts of many texts: short ones are joined, long ones cut where a period begins."""
    size, step = length - PERIOD + 1, max(1, BLOCK // PERIOD) * PERIOD

    def part(held: list[tuple[int, int, int, bytes]]) -> Part:
        row, base, n, pieces = zip(*held, strict=True)
        row, base, n, sizes = np.array(row, np.int64), np.array(base, np.int64), np.array(n, np.int64), np.array([len(x) for x in pieces], np.int64)
        begin, periods = np.cumsum(sizes) - sizes, -(-n // PERIOD)
        own = np.repeat(np.arange(len(n)), periods)
        within = ((np.arange(len(own)) - np.repeat(np.cumsum(periods) - periods, periods))[:, None] * PERIOD + COVER).ravel()
        own = np.repeat(own, len(COVER))
        own, within = own[within < n[own]], within[within < n[own]]
        which, hi, lo = samples(b"".join(pieces), begin[own] + within, (begin + sizes)[own], length, rounds, bucket)
        own = own[which]
        return hi, lo, base[own] + within[which], np.zeros(len(which), np.int64), np.zeros(0, np.uint64), row[own]

    held: list[tuple[int, int, int, bytes]] = []
    total = 0
    for row, data in rows:
        last = len(data) - size + 1
        for s in range(0, last, step):
            n = min(last - s, step)
            held.append((row, s, n, data[s : s + n + length - 1]))
            total += len(held[-1][3])
            if total >= BLOCK:
                yield part(held)
                held, total = [], 0
    if held:
        yield part(held)


def slots(names: np.ndarray, bits: int) -> np.ndarray:
    """The slots of names in the bitmap, one for each step."""
    return (mix(names[:, None] + np.arange(1, len(STEPS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)


def open_steps(at: np.ndarray, sure: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each named sample of a text of n bytes, the steps with suffixes that may cover bytes which repeated samples do not."""
    first, last = at[:, None] - STEPS[1:] + 1, at[:, None] - STEPS[:-1]  # where suffixes of a step begin
    first, last = np.maximum(first, 0), np.minimum(last, n - length)
    begin, end = runs(at[sure], length)
    if len(begin):
        k = np.searchsorted(begin, first, "right") - 1
        inside = (k >= 0) & (first <= end[k] - length)
        return (np.where(inside, end[k] - length + 1, first) <= last) & (first <= last)
    return first <= last


def suffixes(data: bytes, at: np.ndarray, called: np.ndarray, asked: np.ndarray, length: int, rounds: int, bucket: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hi, lo, off, base, names) of a text's suffixes in a bucket that a named sample follows in a step asked for; at, called, asked: the named samples, in order, and their steps; base: where in names those of the suffix's period begin."""
    edge, width = PERIOD - 1, len(COVER)
    view = np.frombuffer(data, np.uint8)
    near, step = np.nonzero(asked)
    if not len(near):
        return
    begins, ends = at[near] - STEPS[1:][step] + 1, at[near] - STEPS[:-1][step] + 1
    for s in range(0, len(data) - length + 1, BLOCK):
        e = min(len(data) - length + 1, s + BLOCK)
        lo, hi = np.searchsorted(at, [s, e + PERIOD])
        p = at[lo:hi]
        if not len(p):
            continue
        change = np.bincount(np.clip(begins, s, e) - s, minlength=e - s + 1) - np.bincount(np.clip(ends, s, e) - s, minlength=e - s + 1)
        off = s + np.flatnonzero(np.cumsum(change)[:-1] > 0)
        head = words(view, off, edge // 8)
        mine = mix(head[:, 0]) % np.uint64(rounds) == bucket
        off, head = off[mine], head[mine]
        names = np.zeros(((e - s) // PERIOD + 4) * width, np.uint64)
        names[(p // PERIOD - s // PERIOD) * width + _ORDER[p % PERIOD]] = called[lo:hi]
        a, b = hashed(head), hashed(words(view, off + length - edge, edge // 8))
        yield mix(a + (b << np.uint64(1))), mix(b ^ (a << np.uint64(17) | a >> np.uint64(47))), off, (off // PERIOD - s // PERIOD) * width, names


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray], **same: object) -> pd.DataFrame:
    """One row for each part, with its rows of the columns as bytes."""
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(part[order]) != 0, True)) + 1 if len(part) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    made = {c: [v[order[a:b]].tobytes() if len(v) else b"" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] for c, v in columns.items()}
    return pd.DataFrame({"part": part[order[starts]] if len(ends) else [], **made}).assign(**same)


def _row_part(row: np.ndarray, parts: int) -> np.ndarray:
    return (mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each part whole; they come sorted by part."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for part, rows in batch.groupby("part", sort=True):
            if held and held[0].part.iloc[0] != part:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def thinned(row: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Which places are enough to tell the bytes that strings at all of them cover: the first and last in each half length of a text."""
    order = np.lexsort((off, row))
    half = off[order] // (length // 2)
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (half[1:] != half[:-1])) if len(row) else np.zeros(0, bool)
    return order[new | np.append(new[1:], True)[: len(new)]]


def repeated(rows: DataFrame, found: Callable[[Iterator[pd.DataFrame]], Iterator[Part]], parts: int, wide: int, bare: bool, length: int) -> DataFrame:
    """Which positions stand twice, as part, row, off and (bare: their own names, and which are sure), else only those that tell the bytes covered; found(batches) gives the parts, with `wide` names for each place."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Part] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            hi, lo, off, base, names, row = (np.concatenate(x) for x in zip(*held, strict=True))
            if bare:
                known, sure, on = twins(hi, lo)
                called = names
            else:
                before = np.cumsum([0, *(len(h[4]) for h in held[:-1])])
                base = base + np.repeat(before, [len(h[0]) for h in held])
                place = off % PERIOD
                known, on = settled(hi, lo, place, lambda rows, slots: names[base[rows] + NUMBERS[place[rows], slots]])
                sure, called = known, names[base[on][:, None] + NUMBERS[place[on]]]
            yield _dealt((hi[on] >> np.uint64(20)).astype(np.int64) % parts, {"hi": hi[on], "lo": lo[on], "row": row[on], "off": off[on].astype(np.int32), "names": called}, known=False)
            told = np.flatnonzero(known)
            told = told if bare else told[thinned(row[told], off[told], length)]
            yield _dealt(_row_part(row[told], parts), {"hi": hi[told] if bare else hi[:0], "lo": sure[told] if bare else sure[:0], "row": row[told], "off": off[told].astype(np.int32)}, known=True, names=b"")

        for part in found(batches):
            if len(part[0]):
                held.append(part)
                size += len(part[0])
            if size >= BATCH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _parts(batches):
            told, group = group[group.known], group[~group.known]
            hi, lo, row, off = _joined(group.hi, "<u8"), _joined(group.lo, "<u8"), _joined(group.row, "<i8"), _joined(group.off, "<i4").astype(np.int64)
            if bare:
                twice, sure, _ = twins(hi, lo)
            else:
                names = _joined(group.names, "<u8").reshape(len(hi), wide)
                twice, _ = settled(hi, lo, off % PERIOD, lambda rows, slots: names[rows, slots])  # noqa: B023
            row, off = np.concatenate([row[twice], _joined(told.row, "<i8")]), np.concatenate([off[twice], _joined(told.off, "<i4")])
            if bare:
                called, sure = np.concatenate([hi[twice], _joined(told.hi, "<u8")]), np.concatenate([sure[twice], _joined(told.lo, "?")])
                yield _dealt(_row_part(row, parts), {"row": row, "off": off.astype(np.int32), "names": called, "sure": sure})
            else:
                order = thinned(row, off, length)
                yield _dealt(_row_part(row[order], parts), {"row": row[order], "off": off[order].astype(np.int32)}, names=b"", sure=b"")

    dealt = rows.mapInPandas(sent, _ROWS)
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(met, _FOUND)


def by_text(found: DataFrame, parts: int, finish: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, bytes]], columns: str) -> DataFrame:
    """row and finish(off, names, sure) of each row; off in order, each once, and sure if it is so anywhere."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _parts(batches):
            row, off, names, sure = _joined(group.row, "<i8"), _joined(group.off, "<i4"), _joined(group.names, "<u8"), _joined(group.sure, "?")
            order = np.lexsort((~sure, off, row)) if len(sure) else np.lexsort((off, row))
            once = np.append(True, (row[order][1:] != row[order][:-1]) | (off[order][1:] != off[order][:-1]))[: len(row)]
            order = order[once]
            row, off, names, sure = row[order], off[order], names[order] if len(names) else names, sure[order] if len(sure) else sure
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            made = [finish(off[a:b], names[a:b], sure[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True)]
            yield pd.DataFrame({"row": row[starts], **{c: [m[c] for m in made] for c in (made[0] if made else {})}})

    return found.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(gather, f"row long, {columns}")


def runs(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes that strings at these places cover begin and end."""
    off = off.astype(np.int64)
    return merged(off, off + length)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch as one, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    return begin[first], end[np.append(first[1:], True)[: len(begin)]]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffles go when their job has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def asked_for(near: DataFrame, total: int, length: int) -> tuple[np.ndarray, int]:
    """A bitmap with the slots of names and steps whose suffixes may cover more than repeated samples do, and its number of bits; total: bytes of all texts."""
    bits = min(FILTER_BITS, max(1 << 15, power_of_two(total / BIT_BYTES)))

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for n, off, names, sure in zip(batch["size"].tolist(), batch.off, batch.names, batch.sure, strict=True):
                found.append(slots(np.frombuffer(names, "<u8"), bits)[open_steps(np.frombuffer(off, "<i4").astype(np.int64), np.frombuffer(sure, "?"), n, length)])
            yield pd.DataFrame({"slot": np.unique(np.concatenate(found)) + 1})

    slot = near.select("size", "off", "names", "sure").mapInPandas(asks, "slot long")
    maps = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, found in maps.collect():  # bits / 32768 rows of 4 KB
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(found), np.uint8)  # bucket 1 has the numbers 1 to 32768
    return out, bits


def _texts(ids: DataFrame, df: DataFrame, text: str, length: int, steps: Rounds) -> DataFrame:
    """digest, copies, n_bytes, n_removed, starts, ends, kept_sha256 of each distinct text; ids: digest, n_bytes of each row."""
    spark = df.sparkSession
    copies = steps.keep(ids.groupBy("digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")))
    own = df.select(F.unhex(F.sha2(whole(text), 256)).alias("digest"), whole(text).cast("binary").alias("text")).where(F.octet_length("text") >= length)
    work = steps.keep(own.dropDuplicates(["digest"]).withColumn("row", F.monotonically_increasing_id()))
    total = copies.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    named_ = None
    for bucket in range(NAME_ROUNDS):
        take = lambda batches, b=bucket: sampled(((r, t) for x in batches for r, t in zip(x.row.tolist(), x.text, strict=True)), length, NAME_ROUNDS, b)
        one = steps.keep(repeated(work.select("row", "text"), take, parts, 0, True, length))
        named_ = one if named_ is None else named_.unionByName(one)
    called = by_text(named_, parts, lambda off, names, sure: {"off": off.tobytes(), "names": names.tobytes(), "sure": sure.tobytes()}, "off binary, names binary, sure binary")
    near = steps.keep(work.withColumn("size", F.octet_length("text")).join(called, "row"))
    bitmap, bits = asked_for(near, total, length)
    known = spark.sparkContext.broadcast(bitmap)  # FILTER_BITS / 8 bytes at most

    def asked(batches: Iterator[pd.DataFrame], bucket: int) -> Iterator[Part]:
        for batch in batches:
            for row, data, off, names in zip(batch.row.tolist(), batch.text, batch.off, batch.names, strict=True):
                called_ = np.frombuffer(names, "<u8")
                slot = slots(called_, bits)
                steps_ = (known.value[slot >> 3] >> (slot & 7) & 1).astype(bool)
                for part in suffixes(data, np.frombuffer(off, "<i4").astype(np.int64), called_, steps_, length, ROUNDS, bucket):
                    yield *part, np.full(len(part[0]), row, np.int64)

    found = None
    for bucket in range(ROUNDS):
        one = steps.keep(repeated(near.select("row", "text", "off", "names"), lambda batches, b=bucket: asked(batches, b), parts, len(COVER), False, length))
        found = one if found is None else found.unionByName(one)

    def spans(off: np.ndarray, *_: np.ndarray) -> dict[str, bytes]:
        begin, end = runs(off, length)
        return {"begin": begin.tobytes(), "end": end.tobytes()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, text_, off, sure, *more in zip(*(batch[c] for c in ("digest", "text", "off", "sure", "begin", "end")), strict=True):
                own = runs(np.frombuffer(off, "<i4")[np.frombuffer(sure, "?")], length)
                begin, end = merged(*(np.concatenate([a, np.frombuffer(b or b"", "<i8")]) for a, b in zip(own, more, strict=True)))
                if len(begin):
                    out.append((digest, int((end - begin).sum()), begin, end, hashlib.sha256(kept(text_, begin, end)).hexdigest()))
            yield pd.DataFrame(out, columns=["digest", "n_removed", "starts", "ends", "kept_sha256"])

    runs_of = by_text(found, parts, spans, "begin binary, end binary")
    gone = near.select("row", "digest", "text", "off", "sure").join(runs_of, "row", "left").drop("row").mapInPandas(cut, "digest binary, n_removed long, starts array<long>, ends array<long>, kept_sha256 string")
    whole_ = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    all_ = lambda v, c: F.when(whole_, v).otherwise(F.col(c)).alias(c)
    return copies.join(gone, "digest", "left").select(
        "digest", "copies", "n_bytes", F.coalesce(all_(F.col("n_bytes"), "n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(all_(F.array(F.lit(0).cast("long")), "starts"), F.array().cast("array<long>")).alias("starts"),
        F.coalesce(all_(F.array(F.col("n_bytes").cast("long")), "ends"), F.array().cast("array<long>")).alias("ends"),
        F.coalesce(all_(F.sha2(F.lit(""), 256), "kept_sha256"), F.lower(F.hex("digest"))).alias("kept_sha256"),
    )


def kept(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """What is left of a text without its removed runs."""
    return b"".join([data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)])


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, starts, ends (of the removed runs, in bytes) kept_sha256 and text_sha256 of each row."""
    if length < 2 * PERIOD:
        raise ValueError(f"repeated strings must have {2 * PERIOD} bytes at least")
    steps = Rounds(df.sparkSession)
    try:
        with _cleaned(df.sparkSession):
            ids = steps.keep(df.select(F.col(key).alias("id"), F.unhex(F.sha2(whole(text), 256)).alias("digest"), F.octet_length(whole(text)).cast("long").alias("n_bytes")))
            texts = steps.keep(_texts(ids, df, text, length, steps))
            found = named(ids.drop("n_bytes"), texts, "digest", "copies", ids.count())
            return saved(found.select(F.col("id").alias(key), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "starts", "ends", "kept_sha256", F.lower(F.hex("digest")).alias("text_sha256")))
    finally:
        steps.close()


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, name: str = "kept") -> DataFrame:
    """df, and in `name` the bytes that are left of each row's text."""
    mark, starts, ends, digest = fresh(df, "mark__", "starts__", "ends__", "digest__")
    gone = repeated_spans(df, text, key, length).where("n_removed > 0").select(F.col("text_sha256").alias(mark), F.col("starts").alias(starts), F.col("ends").alias(ends)).dropDuplicates([mark])
    data = whole(text).cast("binary")
    begin = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(ends, F.array().cast("array<long>")))
    end = F.concat(F.coalesce(starts, F.array().cast("array<long>")), F.array(F.octet_length(data).cast("long")))
    pieces = F.zip_with(begin, end, lambda a, b: F.substring(data, a.cast("int") + 1, (b - a).cast("int")))
    left = F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y))
    return df.withColumn(digest, F.sha2(whole(text), 256)).join(gone, F.col(digest) == F.col(mark), "left").select(*[F.col(f"`{c}`") for c in df.columns], left.alias(name))
