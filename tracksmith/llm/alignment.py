"""Alignment of two tokenizers' tokens over a corpus, with counts of the pairs that they form.

Both tokenizers read every text; where tokens of both end at the same byte, a group ends. Each pair of a group's
tokens is a link. A pair's count is the number of documents that hold it linked.

Texts are encoded once, unit by unit (a word with the white space before it; no token of either tokenizer reaches
from one into the next, which is tried when they are loaded), and kept as ids. Alignment is then a matter of running
sums of token lengths, and is done anew by each pass over the ids:

1. the distinct pairs are gathered, dealt to parts, and each part gets a minimal perfect hash: levels of bits where
   a pair that is alone in its place is set, its number the count of bits set before it, and the pairs themselves in
   that order, so that a pair that was never hashed is told apart;
2. tasks count into dense vectors indexed by the hash, which are summed in a tree, FAN at a time;
3. the second alignment looks the counts up, and the highest count of each token of the first tokenizer.

Passes 2 and 3 send at most KEYS pairs with their hash to the workers at once, and are done again for the next KEYS
where there are more, so memory is bounded at any number of pairs. The highest counts are one number for each entry
of the first vocabulary.

Defined cases: null and empty texts have no tokens, and so do texts that a tokenizer does not give back byte for
byte (their figures are 0, and groups_sha256 is ''); texts of any length are read whole; a group of any size counts
all its links, from its distinct ids and how often each stands there; repeated rows are documents of their own; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, saved
from .hashing import mix
from .lm import narrow

#: Pairs of a part and of a broadcast; vectors that one task adds up; bytes of text aligned at once.
PART, KEYS, FAN, RUN = 1 << 14, 1 << 22, 32, 1 << 20
#: Units encoded as one text.
TOGETHER = 2048
#: Bytes of units and ids, Python's own included, that a worker remembers; links of a group beyond which its distinct ids are taken.
MEMO_BYTES, LARGE = 96 << 20, 4096
_LOOSE = re.compile(r"(?:\A|\s)(?= |\Z)")
_SPREAD = 2654435761
_DIGITS = np.array([list(str(i).ljust(6).encode()) for i in range(1 << 16)], np.uint8)
_LENGTHS = np.array([len(str(i)) for i in range(1 << 16)])


def units(text: str) -> list[str]:
    """The text cut before each space that follows no white space; the spaces at the cuts are left out."""
    parts = text.split(" ")
    if not _LOOSE.search(text):
        return parts
    out, now = [], None
    for p in parts:
        now = p if now is None else f"{now} {p}"
        if p and not p[-1].isspace():
            out.append(now)
            now = None
    return out if now is None else [*out, now]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others counted from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE (A) and a sentencepiece BPE (B), and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.encode().replace("▁".encode(), b" ") for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece reaches over a space, so texts cannot be encoded by units")
        self.lone = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.size = 0
        for text in ("a  b", "x \n y's  ", " \t  z　 1234 ́e", "(a) -- 中文 \U0001f600\U0001f600 ==== \r\n\r\n q"):
            if self.encoded([text])[0] != self.plain(text):
                raise ValueError("texts cannot be encoded by units with these tokenizers")

    def plain(self, text: str) -> tuple[bytes, bytes]:
        """Both tokenizers' ids in 16 bits; none where either does not give back a space and the text."""
        return self._told([text])[0] or (b"", b"")

    def _told(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        found = many([f" {t}" for t in texts], add_special_tokens=False)
        out: list[tuple[bytes, bytes] | None] = []
        for text, e, b in zip(texts, found, self.b.encode(texts, num_threads=1), strict=True):
            a, b, want = e.ids, b if text else [self.lone], f" {text}".encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])
            out.append((np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()) if same else None)
        return out

    def _together(self, new: list[str]) -> list[tuple[bytes, bytes] | None]:
        """As _told(), of units that do not end in white space: as one text, whose tokens are then dealt out."""
        text = " ".join(new)
        many, want = getattr(self.a, "encode_batch_fast", self.a.encode_batch), f" {text}".encode("utf-8", "surrogatepass")
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in new])
        sides = []
        for ids, sizes, names in ((many([f" {text}"], add_special_tokens=False)[0].ids, self.a_sizes, self.a_bytes), (self.b.encode(text), self.b_sizes, self.b_bytes)):
            if b"".join([names[i] for i in ids]) != want:
                return self._told(new)
            at = 2 * (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)
            data = np.array(ids, "<u2").tobytes()
            sides.append([data[i:j] for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)])
        return list(zip(*sides, strict=True))

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """As plain(), of each text, by units."""
        if self.size > MEMO_BYTES:
            self.known, self.size = {}, 0
        cut = [units(t) for t in texts]
        new = list({u for c in cut for u in c} - self.known.keys())
        loose = [u for u in new if not u or u[-1].isspace()]
        firm = [u for u in new if u and not u[-1].isspace()]
        found = [*zip(loose, self._told(loose), strict=True)]
        for i in range(0, len(firm), TOGETHER):
            found += zip(firm[i : i + TOGETHER], self._together(firm[i : i + TOGETHER]), strict=True)
        for u, ids in found:
            self.known[u] = ids
            self.size += 300 + 4 * len(u)
        out = []
        for text, own in zip(texts, cut, strict=True):
            found = [self.known[u] for u in own]
            if not text:
                out.append((b"", b""))
            elif None in found:
                out.append(self.plain(text))
            else:
                out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out


@functools.lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """This worker's; its units stay from task to task."""
    return Tokenizers(a_path, b_path)


@dataclass
class Aligned:
    """Documents' tokens in a row; group: of each token, over all the documents; doc: of each group; starts: each group's first token, and the end."""

    docs: int
    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    doc: np.ndarray

    @property
    def in_a(self) -> np.ndarray:
        return np.bincount(self.group_a, minlength=len(self.doc))

    @property
    def in_b(self) -> np.ndarray:
        return np.bincount(self.group_b, minlength=len(self.doc))

    def linked(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of the links, those of a group of few tokens one by one; a pair is a's id times width plus b's."""
        n, m = self.in_a, self.in_b
        begin = np.cumsum(m) - m
        large = n * m > LARGE
        use = np.flatnonzero(~large[self.group_a])
        each = m[self.group_a[use]]
        first = np.repeat(begin[self.group_a[use]] - (np.cumsum(each) - each), each)
        at = [(np.repeat(self.doc[self.group_a[use]], each), np.repeat(self.a[use], each) * width + self.b[first + np.arange(len(first))], np.ones(len(first), np.int64))]
        for g in np.flatnonzero(large):
            x, p = np.unique(self.a[self.group_a == g], return_counts=True)
            y, q = np.unique(self.b[self.group_b == g], return_counts=True)
            at.append((np.full(len(x) * len(y), self.doc[g]), (x[:, None] * width + y).ravel(), (p[:, None] * q).ravel()))
        doc, pair, times = (np.concatenate(z) for z in zip(*at, strict=True))
        return doc, pair, times

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As linked(), each pair once for each document."""
        doc, pair, times = self.linked(width)
        order = np.argsort(doc * (1 << 33) + pair)  # ids have 16 bits, and a run's documents are below 1 << 30
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
        return doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times

    def said(self) -> list[bytes]:
        """Each document's groups, as "a1,a2|b1;a3|b2,b3"."""
        n, m = self.in_a, self.in_b
        place_a, place_b = np.arange(len(self.a)) + (np.cumsum(m) - m)[self.group_a], np.arange(len(self.b)) + np.cumsum(n)[self.group_b]
        ids, mark = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends = np.cumsum(n + m) - 1
        mark[ends] = ord(";")
        mark[ends - m] = ord("|")
        size = _LENGTHS[ids]
        letters = _DIGITS[ids]
        letters[np.arange(len(ids)), size] = mark
        flat = letters[np.arange(6) <= size[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(size + 1)])
        last = np.concatenate([[-1], ends])[np.searchsorted(self.doc, np.arange(-1, self.docs), "right")]
        return [flat[at[i + 1] : at[j + 1] - 1] if j > i else b"" for i, j in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]


def aligned(a: list[bytes], b: list[bytes], t: Tokenizers) -> Aligned:
    """Documents' ids in 16 bits, aligned; a document has none on either side, or the same bytes on both."""
    ids_a, ids_b = (np.frombuffer(b"".join(x), "<u2") for x in (a, b))
    ends_a, ends_b = np.cumsum(t.a_sizes[ids_a]), np.cumsum(t.b_sizes[ids_b])
    at = np.zeros((ends_a[-1] if len(ends_a) else 0) + 1, np.uint8)
    at[ends_a] = 1
    at[ends_b] += 1
    last_a, last_b = at[ends_a] == 2, at[ends_b] == 2  # the tokens that end a group
    doc = np.repeat(np.arange(len(a)), [len(x) // 2 for x in a])[last_a]
    return Aligned(len(a), ids_a.astype(np.int64), ids_b.astype(np.int64), np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, doc)


def runs(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch in pieces of about RUN bytes of ids, one row at least."""
    sizes = batch.a.map(len).to_numpy(np.int64).cumsum() if len(batch) else np.zeros(0, np.int64)
    for _, piece in batch.groupby(sizes // RUN, sort=True):
        yield piece


def part_of(pair: Any, parts: int) -> Any:
    """A pair's part; the same for numbers, arrays and (with shifted()) columns."""
    return ((pair % (1 << 31) * _SPREAD) >> 20) % parts


def hashed(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct pairs: (levels' sizes, their bits, the pairs in the hash's order)."""
    sizes, bits, placed, left = [], [], [], pairs
    while len(left):
        size = 2 * len(left) + 1
        at = _at(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        placed.append(left[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(alone)
        left = left[~mine]
    return np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, bool)]), np.concatenate([*placed, np.zeros(0, np.int64)])


def _at(pairs: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(level).astype(np.uint64) + np.uint64(1))) % np.asarray(size, np.uint64)).astype(np.int64)


class Hash:
    """The hashes of parts lo to hi, as one: a pair's number, or -1 where it is not among them."""

    def __init__(self, rows: list, parts: int) -> None:
        self.parts = parts
        rows = sorted(rows, key=lambda r: r.part)
        self.numbers = np.array([r.part for r in rows], np.int64)
        self.row = np.full(parts, -1, np.int64)
        self.row[self.numbers] = np.arange(len(rows))
        levels = [np.frombuffer(bytes(r.sizes), np.int64) for r in rows]
        deep = max(map(len, levels), default=0)
        self.sizes = np.array([np.pad(x, (0, deep - len(x))) for x in levels], np.int64).reshape(len(rows), deep)
        own = self.sizes.sum(axis=1)
        self.bases = (np.cumsum(own) - own)[:, None] + np.cumsum(self.sizes, axis=1) - self.sizes
        bits = [np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=int(n)) for r, n in zip(rows, own, strict=True)]
        set_ = np.concatenate([*bits, np.zeros(0, np.uint8)])
        self.rank = np.where(set_ == 1, np.cumsum(set_, dtype=np.int64) - 1, -1).astype(np.int32)
        pairs = [np.frombuffer(bytes(r.pairs), np.int64) for r in rows]
        self.ends = np.cumsum([len(p) for p in pairs]).astype(np.int64)
        self.pairs = np.concatenate([*pairs, np.zeros(0, np.int64)])

    def number(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), -1, np.int64)
        row = self.row[part_of(pairs, self.parts)]
        left = np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[left], level]
            left = left[size > 0]
            size = size[size > 0]
            at = self.rank[self.bases[row[left], level] + _at(pairs[left], level, size)]
            out[left[at >= 0]] = at[at >= 0]
            left = left[at < 0]
        out[(out >= 0) & (self.pairs[out] != pairs)] = -1  # verified: never hashed
        return out


def align(df: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    steps = Rounds(df.sparkSession)
    try:
        return saved(_align(df, a_path, b_path, text, key, steps))
    finally:
        steps.close()


def _align(df: DataFrame, a_path: str, b_path: str, text: str, key: str, steps: Rounds) -> DataFrame:
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    t = tokenizers(a_path, b_path)
    width, height = len(t.b_bytes), len(t.a_bytes)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizers(a_path, b_path)
        for batch in batches:
            texts = batch.text.fillna("")
            for _, piece in texts.groupby(texts.map(len).to_numpy(np.int64).cumsum() // RUN, sort=True):
                got = own.encoded(piece.tolist())
                yield pd.DataFrame({"id": batch.id[piece.index], "a": [g[0] for g in got], "b": [g[1] for g in got]})

    # Ids travel as text: pandas makes floats of long columns with nulls, which do not hold every id.
    ids = steps.keep(df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(encode, "id string, a binary, b binary"))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, found = tokenizers(a_path, b_path), np.zeros(0, np.int64)
        for batch in batches:
            for piece in runs(batch):
                found = np.union1d(found, aligned(piece.a.tolist(), piece.b.tolist(), own).linked(width)[1])
                if len(found) > KEYS:
                    yield pd.DataFrame({"pair": found})
                    found = found[:0]
        yield pd.DataFrame({"pair": found})

    pairs = steps.keep(ids.select("a", "b").mapInPandas(distinct, "pair long").distinct())
    parts = max(1, math.ceil(pairs.count() / PART))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, order = hashed(np.sort(group.pair.to_numpy(np.int64)))
        return pd.DataFrame({"part": [int(group.part.iloc[0])], "sizes": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()], "pairs": [order.tobytes()]})

    part = (F.shiftright(F.col("pair") % (1 << 31) * _SPREAD, 20) % parts).cast("int").alias("part")  # part_of()
    tables = steps.keep(pairs.select("pair", part).groupBy("part").applyInPandas(build, "part int, sizes binary, bits binary, pairs binary"))
    at_once = max(1, KEYS // PART)
    spans = [(lo, min(parts, lo + at_once)) for lo in range(0, parts, at_once)]
    tasks = ids.rdd.getNumPartitions()

    def sent(rows: DataFrame, lo: int, hi: int) -> Any:
        """The hashes of parts lo to hi, with their counts if rows has them: about KEYS pairs."""
        got = rows.where(F.col("part").between(lo, hi - 1)).collect()
        counts = [np.frombuffer(bytes(r.counts), np.int64) for r in sorted(got, key=lambda r: r.part)] if "counts" in rows.columns else []
        return spark.sparkContext.broadcast((Hash(got, parts), np.concatenate([*counts, np.zeros(0, np.int64)])))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total: np.ndarray | int = 0
        for wide, data in zip(group.wide.tolist(), group.counts, strict=True):
            total = total + np.frombuffer(data, f"<u{wide}").astype(np.int64)
        return _vectors([int(group.part.iloc[0])], [total]).assign(way=group.way.iloc[0])

    def counted(lo: int, hi: int) -> DataFrame:
        known = sent(tables, lo, hi)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, hash_ = tokenizers(a_path, b_path), known.value[0]
            found = np.zeros(len(hash_.pairs), np.int64)
            for batch in batches:
                for piece in runs(batch):
                    at = hash_.number(aligned(piece.a.tolist(), piece.b.tolist(), own).links(width)[1])
                    found += np.bincount(at[at >= 0], minlength=len(found))
            if found.any():
                yield _vectors(hash_.numbers.tolist(), np.split(found, hash_.ends[:-1]))

        shape = "part int, wide int, counts binary"
        vectors, ways = ids.select("a", "b").mapInPandas(count, shape).withColumn("way", F.spark_partition_id()), tasks
        while True:
            ways = math.ceil(ways / FAN)
            vectors = vectors.withColumn("way", F.pmod("way", F.lit(ways))).groupBy("part", "way").applyInPandas(add, f"{shape}, way int")
            if ways == 1:
                return steps.keep(vectors.drop("way"))

    def widened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.frombuffer(c, f"<u{w}").astype(np.int64).tobytes() for w, c in zip(batch.wide.tolist(), batch.counts, strict=True)]
            yield batch.drop(columns="wide").assign(counts=made)

    sums = counted(*spans[0])
    for span in spans[1:]:
        sums = sums.unionByName(counted(*span))
    full = steps.keep(tables.join(sums.mapInPandas(widened, "part int, counts binary"), "part"))

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = np.zeros(height, np.int64)
        for batch in batches:
            for p, c in zip(batch.pairs, batch.counts, strict=True):
                np.maximum.at(most, np.frombuffer(p, np.int64) // width, np.frombuffer(c, np.int64))
        at = np.flatnonzero(most)
        yield pd.DataFrame({"a": at, "most": most[at]})

    best = np.zeros(height, np.int64)
    for a, most in full.select("pairs", "counts").mapInPandas(highest, "a int, most long").groupBy("a").agg(F.max("most")).collect():  # the first vocabulary
        best[a] = most
    tops = spark.sparkContext.broadcast(best)

    def looked_up(lo: int, hi: int, rows: DataFrame) -> DataFrame:
        known, last = sent(full, lo, hi), hi == parts

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, (hash_, counts) = tokenizers(a_path, b_path), known.value
            for batch in batches:
                for piece in runs(batch):
                    x = aligned(piece.a.tolist(), piece.b.tolist(), own)
                    doc, pair, times = x.linked(width)
                    kinds, back = np.unique(pair, return_inverse=True)
                    at = hash_.number(kinds)[back]
                    doc, pair, times, at = doc[at >= 0], pair[at >= 0], times[at >= 0], at[at >= 0]
                    adds = {"count_sum": np.zeros(len(piece), np.int64), "n_best": np.zeros(len(piece), np.int64)}
                    np.add.at(adds["count_sum"], doc, times * counts[at])
                    top = counts[at] == tops.value[pair // width]
                    np.add.at(adds["n_best"], doc[top], times[top])
                    piece = piece.assign(**{c: piece[c].to_numpy(np.int64) + v for c, v in adds.items()})
                    if last:
                        linked = np.zeros(len(piece), np.int64)
                        np.add.at(linked, x.doc, x.in_a * x.in_b)
                        digests = [hashlib.sha256(s).hexdigest() if s else "" for s in x.said()]
                        piece = piece.assign(n_a=piece.a.map(len) // 2, n_b=piece.b.map(len) // 2, n_groups=np.bincount(x.doc, minlength=len(piece)), n_links=linked, groups_sha256=digests).drop(columns=["a", "b"])
                    yield piece

        more = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" if last else "a binary, b binary"
        return rows.mapInPandas(look, f"id string, n_best long, count_sum long, {more}")

    rows = ids.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i, span in enumerate(spans):
        rows = looked_up(*span, rows if i == 0 else steps.keep(rows))
    return rows.select(F.col("id").cast(kind).alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _vectors(numbers: list[int], counts: list[np.ndarray]) -> pd.DataFrame:
    """Rows of counts in as few bytes as hold them."""
    small = [narrow(c) for c in counts]
    return pd.DataFrame({"part": numbers, "wide": [c.itemsize for c in small], "counts": [c.tobytes() for c in small]})
