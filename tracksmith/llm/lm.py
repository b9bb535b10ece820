"""Interpolated modified Kneser-Ney n-gram model of order 2 to 4, counted in Spark, kept as sorted hash arrays that workers map.

The model lives in the shared folder (spark.checkpoint.dir, which must be mounted, as files are mapped from it):

* vocabulary parts: sorted hashes of the words and their counts; a word's number is its place over all parts;
* for each length up to the order, parts of sorted n-grams: a mixture of all their words' numbers and the words before
  the last two (a bijection, so no two n-grams collide), with counts: how often the longest stand there, how many words
  stand before each shorter one;
* parts of contexts, with the sum of what follows and how many words follow once, twice, more often.

A word's number has as many bits as the vocabulary needs, and a part holds only the bits that its place does not tell.
Counts, of one kind or more, are a byte each, with a list beside for those that a byte does not hold. Counting sends
sorted runs of distinct n-grams, dealt by a hash of the whole n-gram, so that every part has about the same size
whatever the most frequent words, pairs and contexts are. Each part is merged by one task. Shorter n-grams are counted from the longer ones' files, so
that each step's shuffle can go before the next. Counts are whole at any size; 2**32 distinct words or more raise an
error, as two no longer fit into a key. Scoring reads whole texts in runs and looks sorted keys up part by part.

A text begins with as many begin marks as a context is long; the marks are words of n-grams like others, but are never
predicted. So a beginning of fewer words has one word before it, a mark.

Defined cases: a null text counts as empty and has one token, the end; unknown words get the model's share for
unknown words; without training texts the model is uniform; repeated rows count as often as they stand there;
texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import power_of_two, saved, shared_dir, slices

#: N-grams that a part should get, n-grams after which a counting task sends what it has, bytes of text looked up at a time.
PART_KEYS, FLUSH_KEYS, RUN_BYTES = 3_000_000, 3_000_000, 2 << 20
#: The token that ends a text, as a word's hash.
END = np.uint64(0x9D39247E33776D41)
#: Odd numbers that spread keys.
_DEAL = np.uint64(0x9E3779B97F4A7C15)
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Shuffles go when their job has ended (Spark 4.1 and later; elsewhere they stay until Spark collects them).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def mounted(uri: str) -> str:
    """The local path of a folder in the shared file system."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays are mapped from files; {uri} is no mounted folder")
    return parts.path


def mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def up(x: np.ndarray, bits: int) -> np.ndarray:
    """x << bits, for 64 bits too."""
    return x << np.uint64(bits) if bits < 64 else np.zeros_like(x)


def down(x: np.ndarray, bits: int) -> np.ndarray:
    """x >> bits, for 64 bits too."""
    return x >> np.uint64(bits) if bits < 64 else np.zeros_like(x)


def stir(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits that spreads them evenly."""
    half = (bits + 1) // 2
    for odd in _ODD:
        x = (x ^ down(x, half)) * np.uint64(odd) & mask(bits)
    return x ^ down(x, half)


def unstir(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of stir()."""
    half = (bits + 1) // 2
    for odd in reversed(_ODD):
        x = (x ^ down(x, half)) * np.uint64(pow(odd, -1, 1 << 64)) & mask(bits)
    return x ^ down(x, half)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the least of 1, 2, 4 and 8 bytes that holds them all."""
    most = int(n.max(initial=0))
    return n.astype(f"<u{next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)}")


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays of any widths and lengths, one behind the other; unpack() reads them without a copy."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<u8")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: np.ndarray) -> list[np.ndarray]:
    head = data[8 : 8 + 16 * int(data[:8].view("<u8")[0])].view("<u8").reshape(-1, 2).astype(np.int64)
    ends = np.cumsum([8 + 16 * len(head), *(head[:, 0] * head[:, 1])])
    return [data[a:b].view(f"<u{w}") for a, b, w in zip(ends[:-1], ends[1:], head[:, 0], strict=True)]


def small(n: np.ndarray) -> list[np.ndarray]:
    """Counts (a row for each kind) as a byte for each place: which column of a table it has, the most frequent 255 columns; then the places and columns of all others."""
    table = np.zeros((len(n), 256), np.int64)
    if len(n) == 1:
        code, table[0] = np.minimum(n[0], 255), np.arange(256)
    else:
        width = 24 // len(n)
        few = np.flatnonzero((n < 1 << width).all(axis=0))
        packed = sum(n[k, few] << width * k for k in range(len(n)))
        values, which, often = np.unique(packed, return_inverse=True, return_counts=True)
        keep = np.argsort(-often, kind="stable")[:255]
        codes = np.full(len(values), 255)
        codes[keep] = np.arange(len(keep))
        code = np.full(n.shape[1], 255)
        code[few] = codes[which]
        for k in range(len(n)):
            table[k, : len(keep)] = values[keep] >> width * k & (1 << width) - 1
    rare = np.flatnonzero(code == 255)
    return [code.astype("u1"), narrow(table.ravel()), narrow(rare), narrow(n[:, rare].ravel())]


def counts_at(four: list[np.ndarray], place: np.ndarray, kinds: int = 1) -> np.ndarray:
    """What small() made, at some places: a row for each kind."""
    code = four[0][place]
    out = four[1].reshape(kinds, 256)[:, code].astype(np.int64)
    rare = np.flatnonzero(code == 255)
    out[:, rare] = four[3].reshape(kinds, -1)[:, np.searchsorted(four[2], place[rare])]
    return out


def store(path: str, arrays: list[np.ndarray]) -> None:
    """A file that appears whole or not at all."""
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(pack(arrays))
    os.replace(made, path)


@functools.lru_cache(maxsize=256)
def mapped(path: str) -> list[np.ndarray] | None:
    """The arrays of a stored file, mapped; none where a part has no n-grams."""
    return unpack(np.asarray(np.memmap(path, np.uint8, "r"))) if os.path.exists(path) else None


@dataclass(frozen=True)
class Layout:
    """How n-grams are keys, and keys are dealt to parts."""

    length: int  # words of an n-gram, 1 to 4
    width: int  # bits of a word's number
    bits: int  # the first bits of a key that name its part

    @property
    def high(self) -> int:
        """Bits of a key, of which the last two words and what stands before are made."""
        return self.width * min(self.length, 2)

    @property
    def low(self) -> int:
        """Bits of the rest, the words before the last two."""
        return self.width * max(self.length - 2, 0)

    @property
    def left(self) -> int:
        """Bits of a key that its part does not tell."""
        return self.high - self.bits

    def keyed(self, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(key, rest) of n-grams, from their words' numbers, first to last."""
        w = [x.astype(np.uint64) for x in w]
        plain = w[-1] if self.length == 1 else up(w[-2], self.width) | w[-1]
        rest = {3: lambda: w[0], 4: lambda: up(w[0], self.width) | w[1]}.get(self.length, lambda: np.zeros_like(plain))()
        return stir(plain, self.high) + rest * _DEAL & mask(self.high), rest

    def worded(self, key: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """What keyed() was made of."""
        plain, one = unstir(key - rest * _DEAL & mask(self.high), self.high), mask(self.width)
        before = {3: lambda: [rest], 4: lambda: [down(rest, self.width), rest & one]}.get(self.length, list)()
        return [*before, *([plain] if self.length == 1 else [down(plain, self.width), plain & one])]

    def ends(self, key: np.ndarray) -> np.ndarray:
        """Where parts begin among sorted keys, and the end."""
        return np.searchsorted(down(key, self.left).astype(np.int64), np.arange((1 << self.bits) + 1))

    def inner(self, key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a part does not tell of its n-grams, as two numbers that sort as the n-grams do; the second is 0 if one has room for all."""
        key, spare = key & mask(self.left), 64 - self.left
        if self.low <= spare:
            return up(key, self.low) | rest, np.zeros_like(key)
        return up(key, spare) | down(rest, self.low - spare), rest & mask(self.low - spare)

    def outer(self, part: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, rest) of what inner() made."""
        spare = 64 - self.left
        if self.low <= spare:
            key, rest = down(first, self.low), first & mask(self.low)
        else:
            key, rest = down(first, spare), up(first & mask(spare), self.low - spare) | second
        return up(np.full_like(key, part), self.left) | key, rest

    def packed(self, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
        """What inner() made, in few bytes: the first 32 bits of what there are (64 if more than 64), then the others."""
        if self.left + self.low > 64:
            return [first.astype("<u8"), narrow(second)]
        under = max(self.left + self.low - 32, 0)
        return [down(first, under).astype("<u4"), narrow(first & mask(under))]

    def unpacked(self, keys: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, rests = keys.astype(np.uint64), rests.astype(np.uint64)
        if self.left + self.low > 64:
            return keys, rests
        return up(keys, max(self.left + self.low - 32, 0)) | rests, np.zeros_like(keys)


def laid_out(length: int, width: int, bits: int) -> Layout:
    """A layout of 2 ** bits parts, or of as many as there can be keys."""
    return Layout(length, width, min(bits, width * min(length, 2)))


@dataclass(frozen=True)
class Shape:
    """What workers must know to find their way in the files."""

    folder: str
    order: int
    hashes: Layout  # of the vocabulary, whose words are told by their hashes
    starts: np.ndarray  # the number of each vocabulary part's first word, and at the end the number of words
    grams: tuple[Layout, ...] = ()  # of each length, from one word on

    @property
    def words(self) -> int:
        return int(self.starts[-1])


def ordered(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and rest, and where new n-grams begin in it. Keys with several rests are few where keys have 64 bits."""
    order = np.argsort(key)
    k, r = key[order], rest[order]
    if ((k[1:] == k[:-1]) & (r[1:] != r[:-1])).any():
        order = np.lexsort((rest, key))
        k, r = key[order], rest[order]
    new = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), new]))


#: (keys, rests, counts: a row for each kind)
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def counted(key: np.ndarray, rest: np.ndarray) -> Table:
    """The distinct n-grams, sorted, and how often they stand there."""
    order, first = ordered(key, rest)
    return key[order[first]], rest[order[first]], np.diff(np.append(first, len(key)))[None]


def summed(tables: list[Table]) -> Table:
    """The distinct n-grams of all tables, sorted, with their sums."""
    key, rest, n = (np.concatenate(x, axis=-1) for x in zip(*tables, strict=True))
    order, first = ordered(key, rest)
    if len(first) == len(key):
        return key[order], rest[order], n[:, order]
    return key[order[first]], rest[order[first]], np.add.reduceat(n[:, order], first, axis=1)


def sent(tables: list[Table], layout: Layout) -> pd.DataFrame:
    """A row for each part: however often an n-gram stands in the tables, it is sent once."""
    key, rest, n = summed(tables)
    ends = layout.ends(key)
    use = np.flatnonzero(np.diff(ends))
    keys, rests = layout.packed(*layout.inner(key, rest))
    cut = [slice(int(ends[p]), int(ends[p + 1])) for p in use]
    return pd.DataFrame({"part": use, "data": [pack([keys[at], rests[at], *(narrow(k[at]) for k in n)]) for at in cut]})


def looked_up(key: np.ndarray, rest: np.ndarray, layout: Layout, files: dict[str, int]) -> np.ndarray:
    """The counts of each n-gram in the files of some names, so many kinds each, 0 where they do not have it; in the last row its place in the last and one more."""
    order, first = ordered(key, rest)
    own, of = key[order[first]], rest[order[first]]
    ends = layout.ends(own)
    own, of = layout.packed(*layout.inner(own, of))
    got = np.zeros((sum(files.values()) + 1, len(first)), np.int64)
    for p in np.flatnonzero(np.diff(ends)).tolist():
        at, row = np.arange(ends[p], ends[p + 1]), 0
        for name, kinds in files.items():
            if (have := mapped(f"{name}-{p}")) is not None:
                keys, rests = have[:2]
                low = np.searchsorted(keys, own[at])
                there = np.flatnonzero(low < len(keys))
                there = there[keys[low[there]] == own[at[there]]]
                more = there[rests[low[there]] != of[at[there]]]  # few: another n-gram has the same first bits
                begin, end = low[more] + 1, np.searchsorted(keys, own[at[more]], "right")
                while (left := np.flatnonzero(begin < end)).size:  # rests are sorted where keys are the same
                    middle = (begin[left] + end[left]) // 2
                    under = rests[middle] < of[at[more[left]]]
                    begin[left[under]], end[left[~under]] = middle[under] + 1, middle[~under]
                low[more] = np.minimum(begin, len(keys) - 1)
                there = there[(keys[low[there]] == own[at[there]]) & (rests[low[there]] == of[at[there]])]
                got[row : row + kinds, at[there]] = counts_at(have[2:6], low[there], kinds)
                got[-1, at[there]] = low[there] + 1
            row += kinds
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return got[:, back]


def numbers_of(hashes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word (-1: unknown) and its count."""
    count, place = looked_up(hashes, np.zeros_like(hashes), shape.hashes, {f"{shape.folder}/words": 1})
    return np.where(place > 0, shape.starts[down(hashes, shape.hashes.left).astype(np.int64)] + place - 1, -1), count


def tokens(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token: the words of each text, and its end."""
    w = hashing.words(run, lower=True)
    last = np.searchsorted(w.text, np.arange(len(run)), "right")
    return np.insert(w.hash, last, END), np.insert(w.text, last, np.arange(len(run)))


def marked(number: np.ndarray, text: np.ndarray, texts: int, marks: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with `marks` begin marks before each text, and the place of each token among them."""
    place = np.arange(len(number)) + (text + 1) * marks
    out = np.full(len(number) + texts * marks, begin, np.int64)
    out[place] = number
    return out, place


def count_grams(texts: DataFrame, grams_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], layout: Layout) -> DataFrame:
    """(part, data): sorted runs of the n-grams that grams_of finds in the texts, with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Table] = []
        for batch in batches:
            for _, part in slices(batch.iloc[:, 0], RUN_BYTES):
                held.append(counted(*grams_of(part)))
                if sum(len(k) for k, *_ in held) > FLUSH_KEYS:
                    held = [summed(held)]
                    if len(held[0][0]) > FLUSH_KEYS / 2:
                        yield sent(held, layout)
                        held = []
        mapped.cache_clear()
        if held:
            yield sent(held, layout)

    return texts.mapInPandas(run, "part int, data binary")


def merged(runs: DataFrame, layout: Layout, name: str) -> np.ndarray:
    """Writes each part's distinct n-grams and sums, a part by one task. A row for each part: its size, the first kind's sum, how many have 1, 2, 3, 4 and 3 or more of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Table]] = {}
        for batch in batches:
            for p, data in zip(batch.part, batch.data, strict=True):
                keys, rests, *n = unpack(np.frombuffer(data, np.uint8))
                held.setdefault(int(p), []).append((*layout.unpacked(keys, rests), np.stack(n).astype(np.int64)))
        for p in list(held):
            first, second, n = summed(held.pop(p))
            store(f"{name}-{p}", [*layout.packed(first, second), *small(n)])
            yield pd.DataFrame([[p, len(first), int(n[0].sum()), *(int((n[0] == k).sum()) for k in (1, 2, 3, 4)), int((n[0] >= 3).sum())]])

    rows = runs.repartitionById(1 << layout.bits, F.col("part")).mapInPandas(run, "part long, size long, total long, n1 long, n2 long, n3 long, n4 long, more long").collect()
    out = np.zeros((1 << layout.bits, 7), np.int64)
    for r in rows:
        out[r["part"]] = r[1:]
    return out


def shorter(spark: SparkSession, name: str, upper: Layout, layout: Layout, contexts: bool) -> DataFrame:
    """(part, data): from the files of n-grams of one word more, what follows the first words, or what stands before the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.id:
                if (have := mapped(f"{name}-{p}")) is None:
                    continue
                w = upper.worded(*upper.outer(p, *upper.unpacked(*have[:2])))
                if contexts:
                    n = counts_at(have[2:6], np.arange(len(have[0])))[0]
                    yield sent([(*layout.keyed(w[:-1]), np.stack([n, n == 1, n == 2, n >= 3]).astype(np.int64))], layout)
                else:
                    yield sent([counted(*layout.keyed(w[1:]))], layout)
        mapped.cache_clear()

    return spark.range(0, 1 << upper.bits, 1, 1 << upper.bits).mapInPandas(run, "part int, data binary")


def fits(words: int) -> int:
    """The number of distinct words, of which two must go into a key of 64 bits."""
    if words >= 1 << 32:
        raise OverflowError(f"{words} distinct words: a pair of their numbers does not fit into 64 bits")
    return words


def bits_for(keys: float) -> int:
    return min(20, power_of_two(keys / PART_KEYS).bit_length() - 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many keys have the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.0), 0.95 * k) for k, d in enumerate(raw, 1))])


@dataclass(frozen=True)
class Model:
    shape: Shape
    tokens: int  # training tokens
    cuts: tuple[np.ndarray, ...]  # each length's discounts
    follows: int  # distinct pairs of a word and the word before
    rest: float  # the share of the lowest order that goes to all words alike


@contextlib.contextmanager
def trained(texts: DataFrame, order: int = 3) -> Iterator[Model]:
    """A model of the texts (one string column) whose files are there as long as the block runs."""
    spark = texts.sparkSession
    folder = f"{mounted(shared_dir(spark)).rstrip('/')}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        try:
            model = train(texts, folder, order)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        yield model
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def train(texts: DataFrame, folder: str, order: int) -> Model:
    """Counts the texts (one string column) and writes the model's files into the folder."""
    if not 2 <= order <= 4:
        raise ValueError(f"order {order}: 2 to 4 words go into a key")
    size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(texts.columns[0]))), F.lit(0))).first()[0]
    bits = bits_for(size / 24)  # a task's distinct words are about a quarter of its words or fewer
    hashes = laid_out(1, 64, bits)

    def words_of(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, _ = tokens(run)
        return h, np.zeros_like(h)

    found = merged(count_grams(texts, words_of, hashes), hashes, f"{folder}/words")
    starts = np.concatenate([[0], np.cumsum(found[:, 0])])
    words = fits(int(starts[-1]))
    width = max(words.bit_length(), 1)  # the begin mark's number is the number of words
    grams = tuple(laid_out(n, width, bits_for(size / 24 if n == 1 else size / 7 * 0.7 * (0.5 + 0.25 * n))) for n in range(1, order + 1))
    shape = Shape(folder, order, hashes, starts, grams)

    def grams_of(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, text = tokens(run)
        number, place = marked(numbers_of(h, shape)[0], text, len(run), order - 1, words)
        return grams[-1].keyed([number[place - k] for k in range(order - 1, -1, -1)])

    made = [merged(count_grams(texts, grams_of, grams[-1]), grams[-1], f"{folder}/grams{order}")]
    for n in range(order - 1, 0, -1):
        before, after = (shorter(texts.sparkSession, f"{folder}/grams{n + 1}", grams[n], grams[n - 1], contexts) for contexts in (False, True))
        made.insert(0, merged(before, grams[n - 1], f"{folder}/grams{n}"))
        merged(after, grams[n - 1], f"{folder}/contexts{n}")  # a job of its own, so that half as much is shuffled at a time
    _, follows, m1, m2, _, _, more = made[0].sum(axis=0).tolist()
    cuts = tuple(discounts(m[:, 2:6].sum(axis=0)) for m in made)
    rest = float(cuts[0][1] * m1 + cuts[0][2] * m2 + cuts[0][3] * more) / follows if follows else 1.0
    return Model(shape, int(found[:, 1].sum()), cuts, follows, rest)


def scored(run: list[bytes], m: Model) -> pd.DataFrame:
    """n_tokens, n_known, base_score and score of each text of a run."""
    h, text = tokens(run)
    own, count = numbers_of(h, m.shape)
    words, order = m.shape.words, m.shape.order
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (words + 1)))
    number, place = marked(own, text, len(run), order - 1, words)
    p = np.full(len(own), m.rest / (words + 1))
    after = np.zeros((4, len(own)), np.int64)  # of the context: the sum of what follows, and how many words follow once, twice, more often
    for n in range(1, order + 1):
        files = {f"{m.shape.folder}/grams{n}": 1} | ({f"{m.shape.folder}/contexts{n}": 4} if n < order else {})

        def at(places: np.ndarray, n: int = n, files: dict[str, int] = files) -> np.ndarray:
            w = [number[places - k] for k in range(n - 1, -1, -1)]
            known = np.flatnonzero(np.min(w, axis=0) >= 0)
            out = np.zeros((sum(files.values()), len(places)), np.int64)
            out[:, known] = looked_up(*m.shape.grams[n - 1].keyed([x[known] for x in w]), m.shape.grams[n - 1], files)[:-1]
            return out

        got, cut = at(place), m.cuts[n - 1]
        less = got[0] - cut[np.minimum(got[0], 3)]
        if n == 1:
            p += less / m.follows if m.follows else 0.0
        else:
            ready = np.flatnonzero(after[0])
            p[ready] = (less[ready] + (cut[1:] @ after[1:, ready]) * p[ready]) / after[0, ready]
        if n < order:
            first = np.concatenate([[True], text[1:] != text[:-1]])
            after = np.concatenate([np.zeros((4, 1), np.int64), got[1:, :-1]], axis=1)
            after[:, first] = at(place[first] - 1)[1:]
    n = len(run)
    return pd.DataFrame({"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, own >= 0, n).astype(np.int64), "base_score": np.bincount(text, base, n), "score": np.bincount(text, np.log10(p), n)})


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), perplexity of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)  # some numbers and one for each part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, part in slices(batch.text, RUN_BYTES):
                out = scored(part, held.value)
                out.insert(0, "key", batch.key.iloc[start : start + len(part)].to_numpy())
                yield out
        mapped.cache_clear()  # a mapped file keeps its disk when it is removed

    kind = dict(df.dtypes)[key]
    # Ids travel as text: pandas makes floats of long columns with nulls, which do not hold every id.
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, "key string, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("key").cast(kind).alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out_scores(df: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", order: int = 3) -> DataFrame:
    """Trains on the rows that are not held out and scores all; the model's files go when the scores are saved, or when that fails."""
    with trained(df.where(~held_out).select(F.col(text).cast("string").alias("text")), order) as model:
        return saved(score(df, model, text, key))
