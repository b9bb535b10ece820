"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, so equal passages fall into equal chunks wherever
they stand. Chunks that several places hold are encoded once, in a table keyed by their digest; a text that holds
none is encoded where it is read. A chunk's ids are right but for its first and last units, which may go on in
the neighbour: where chunks meet, the text around the join is encoded again, with more on both sides until it
agrees with the chunks' own ids there, and what came out between replaces them.

Which chunks are shared is told to the readers by a bitmap of at most FILTER_BITS bits. Where it errs, a chunk
that stands alone takes the way of the shared ones; results do not depend on it.

Defined cases: a null text counts as empty, and an empty text has no tokens; texts of any length are encoded
whole; texts that hold special tokens' strings get those tokens' ids, as the library does by default; repeated
rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import power_of_two, saved, slices

#: A chunk ends where MASK's bits of the rolling hash are zero (about every 2 KB), and is LEAST to MOST bytes long.
MASK, LEAST, MOST = np.uint32(0x7FF << 13), 256, 1 << 16
FILTER_BITS = 1 << 28
#: Bytes of units and their ids, Python's own included, that one of a worker's two generations holds; units beside a join that must agree; ids that are joined as texts at once.
MEMO_BYTES, GUARDS, RUN = 56 << 20, 3, 1 << 16
# Fixed value: the white space of Unicode.
_SPACES = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+\\Z")
_BYTE_UNITS = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+\Z")
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end, the text's end included; texts stand in data from offsets[i] to offsets[i + 1]."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # a gear hash of the last 32 bytes, by doubling
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero(((h & MASK) == 0)[:-1] & ((data[1:] & 0xC0) != 0x80)) + 1
    out, lo = [], np.searchsorted(places, offsets)
    for i in range(len(offsets) - 1):
        begin, end, last, found = int(offsets[i]), int(offsets[i + 1]), int(offsets[i]), []
        for p in [*places[lo[i] : lo[i + 1]].tolist(), end]:
            while p - last > MOST:  # no cut for long: one by length, moved to a character's start
                last += MOST
                while last > begin and data[last] & 0xC0 == 0x80:
                    last -= 1
                found.append(last)
            if p == end and end > last:
                found.append(end)
            elif p - last >= LEAST and end - p > 0:
                found.append(p)
                last = p
        out.append(found)
    return out


def chunked(texts: list[bytes]) -> list[list[bytes]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = []
    for i, ends in enumerate(cuts(data, offsets) if len(data) else [[] for _ in texts]):
        begins = [int(offsets[i]), *ends[:-1]]
        base = int(offsets[i])
        out.append([texts[i][b - base : e - base] for b, e in zip(begins, ends, strict=True)] if ends else [])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def slot(d: bytes, bits: int) -> int:
    return int.from_bytes(d[:6], "big") % bits


@dataclass
class Piece:
    """An encoded chunk: its ids; its first and last unit, which may go on in a neighbour, and how many ids stand for each; units beside these, with their numbers of ids."""

    ids: np.ndarray
    head: bytes
    tail: bytes
    n_head: int
    n_tail: int
    solid: bool  # one unit or none: head and tail are both the whole chunk
    after: list[bytes]  # up to GUARDS units that follow the head
    before: list[bytes]  # and that come before the tail


class Names:
    """Texts by number, joined with spaces, as bytes: one gather for each RUN of a document's numbers."""

    def __init__(self, texts: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self._run(ids[i : i + RUN]) for i in range(0, len(ids), RUN)])[:-1]

    def _run(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


class Encoder:
    """The library's tokenizer, asked for each unit once while a worker remembers it.

    A unit is a word with the white space before it, or white space at a text's end. No token may reach from a
    unit into the next: that holds for tokenizers that drop white space or keep it in front of words, and is
    tried when the file is loaded; another tokenizer raises ValueError. Where white space is dropped, units are
    remembered without it.
    """

    def __init__(self, path: str) -> None:
        self.path, self._made = path, None
        self.young: dict[bytes, bytes] = {}  # two generations, so that what is used often stays
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    @property
    def tokenizer(self) -> Any:
        if self._made is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
            from tokenizers import Tokenizer

            self._made = Tokenizer.from_file(self.path)
            self._made.no_truncation()
            self._made.no_padding()
            self.dropped = self._drops_white_space()
            names = [self._made.id_to_token(i) or "" for i in range(max(self._made.get_vocab(with_added_tokens=True).values()) + 1)]
            self.names, self.numbers = Names([n.encode() for n in names]), Names([str(i).encode() for i in range(len(names))])
        return self._made

    def _drops_white_space(self) -> bool:
        of = lambda t: self._made.encode(t, add_special_tokens=False).ids
        space = f"{_SPACES}\u2581\u0120\u010a\u0109\u010d"  # with the stand-ins for spaces that vocabularies use; C2 A0 is a space of two bytes
        marks = re.compile(f"(?:[^{space}\u0142]|(?<!\u00c2)\u0142)[{space}]")
        spans = any(marks.search(t) for t in self._made.get_vocab(with_added_tokens=True))
        tried = [(a, s, b) for a in ("word", "Ab", "7", "!?", "é", "中") for s in (" ", "\n", "  ", "\t ") for b in ("next", "É", "42", "..", "文")]
        for drops in (True, False):
            if not spans and all(of(a + s + b) == of(a) + (of(b) if drops else of(s + b)) for a, s, b in tried):
                return drops
        raise ValueError(f"tokens of {self.path} reach over white space; chunks cannot be joined there")

    def units(self, text: bytes) -> list[bytes]:
        """The units of a text; one after the other, they are the text."""
        if self.dropped:
            return _BYTE_UNITS.findall(text)
        return [u.encode() for u in _UNITS.findall(text.decode("utf-8", "replace"))]

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a text: those of its units, one after the other."""
        tokenizer = self.tokenizer
        units = text.split() if self.dropped else self.units(text)
        missing = set(units).difference(self.young)
        if missing:
            if self.size > MEMO_BYTES:
                self.old, self.young, self.size = self.young, {}, 0
                missing = set(units)
            kept = {u: self.old[u] for u in missing if u in self.old}
            unseen = [u for u in missing if u not in kept]
            found = tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in unseen], add_special_tokens=False)
            kept.update((u, np.asarray(e.ids, "<u4").tobytes()) for u, e in zip(unseen, found, strict=True))
            self.young.update(kept)
            self.size += sum(len(u) + len(v) + 200 for u, v in kept.items())
        return np.frombuffer(b"".join(map(self.young.__getitem__, units)), "<u4")

    def piece(self, chunk: bytes) -> Piece:
        ids, units = self.ids(chunk), self.units(chunk)
        if len(units) < 2:
            return Piece(ids, chunk, chunk, len(ids), len(ids), True, [], [])
        return Piece(ids, units[0], units[-1], len(self.ids(units[0])), len(self.ids(units[-1])), False, units[1 : GUARDS + 1], units[-GUARDS - 1 : -1])

    def repaired(self, before: list[bytes], parts: list[bytes], own: np.ndarray, after: list[bytes]) -> np.ndarray:
        """The ids where parts of neighbouring chunks meet.

        They stand if encoding the joined parts gives them again. If not, the text is encoded with one more unit on
        each side, and further ones, until the outermost units come out as they do alone.
        """
        middle = b"".join(parts)
        again = self.ids(middle)
        if np.array_equal(own, again):
            return own
        for n in range(1, GUARDS + 1):
            left, right = self.ids(b"".join(before[-n:])), self.ids(b"".join(after[:n]))
            again = self.ids(b"".join([*before[-n:], middle, *after[:n]]))
            if np.array_equal(again[: len(left)], left) and np.array_equal(again[len(again) - len(right) :], right):
                return again[len(left) : len(again) - len(right)]
        raise ValueError(f"tokens of {self.path} reach over white space near {middle[:80]!r}")

    def join(self, pieces: Iterator[Piece]) -> np.ndarray:
        """The ids of the text that the pieces make up, in order."""
        none = np.zeros(0, "<u4")
        out: list[np.ndarray] = []
        parts: list[bytes] = []  # the text from the last unit on, piece by piece, and its ids
        own: list[np.ndarray] = []
        before: list[bytes] = []
        for p in pieces:
            if p.solid:
                parts.append(p.head)
                own.append(p.ids)
                continue
            out.append(self.repaired(before, [*parts, p.head], np.concatenate([*own, p.ids[: p.n_head]]), p.after))
            out.append(p.ids[p.n_head : len(p.ids) - p.n_tail])
            parts, own, before = [p.tail], [p.ids[len(p.ids) - p.n_tail :]], p.before
        out.append(self.repaired(before, parts, np.concatenate([none, *own]), []))
        return np.concatenate(out)

    def decoded(self, ids: np.ndarray) -> bytes:
        """What decode(ids, skip_special_tokens=False) gives, in UTF-8; without a decoder, that is the tokens with spaces between."""
        if self.tokenizer.decoder is None:
            return self.names.joined(ids)
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()

    def finished(self, ids: np.ndarray, outputs: tuple[str, ...]) -> tuple:
        """The number of ids, and the outputs asked for."""
        text = self.decoded(ids) if {"decoded", "decoded_sha256"} & set(outputs) else b""
        made = {
            "ids": lambda: ids.astype(np.int32),
            "decoded": lambda: text.decode(),
            "ids_sha256": lambda: hashlib.sha256(self.numbers.joined(ids)).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(text).hexdigest(),
        }
        return len(ids), *(made[o]() for o in outputs)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; its words stay from task to task."""
    return _ENCODERS.setdefault(path, Encoder(path))


#: Columns of an encoded chunk.
_PIECE = {"ids": "binary", "head": "binary", "tail": "binary", "n_head": "int", "n_tail": "int", "solid": "boolean", "after": "array<binary>", "before": "array<binary>"}
_PIECES = ", ".join(f"{c} {t}" for c, t in _PIECE.items())


def _said(p: Piece | None) -> tuple:
    return (None,) * len(_PIECE) if p is None else (p.ids.tobytes(), p.head, p.tail, p.n_head, p.n_tail, p.solid, p.after, p.before)


def shared_filter(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """A bitmap with the slot of every chunk that stands at two places or more, and its number of bits."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, run in slices(batch.iloc[:, 0]):
                yield pd.DataFrame({"digest": [digest(c) for chunks in chunked(run) for c in chunks]})

    counts = saved(df.select(F.col(text).alias("text")).mapInPandas(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")))
    bits = int(min(FILTER_BITS, max(1 << 15, power_of_two(8 * counts.count()))))
    at = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % bits
    maps = counts.where("n > 1").select((at + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, found in maps.collect():  # bits / 32768 rows of 4 KB
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(found), np.uint8)  # bucket 1 has the numbers 1 to 32768
    return out, bits


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """key, n_tokens and the outputs of each row; outputs: some of ids, decoded, ids_sha256, decoded_sha256."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    result = ", ".join(["n_tokens long", *(f"{o} {'array<int>' if o == 'ids' else 'string'}" for o in outputs)])
    names = ["n_tokens", *outputs]
    bitmap, bits = shared_filter(df, text)
    known = spark.sparkContext.broadcast(bitmap)  # FILTER_BITS / 8 bytes at most

    def suspected(d: bytes) -> bool:
        place = slot(d, bits)
        return bool(known.value[place >> 3] >> (place & 7) & 1)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            for start, run in slices(batch.text):
                whole = [i for i, chunks in enumerate(chunked(run)) if not any(suspected(digest(c)) for c in chunks)]
                done = [e.finished(e.ids(run[i]), outputs) for i in whole]
                yield pd.DataFrame(done, columns=names).assign(key=batch.key.iloc[[start + i for i in whole]].to_numpy(dtype=object))[["key", *names]]

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            for start, run in slices(batch.text):
                rows: list[tuple] = []
                for i, chunks in enumerate(chunked(run)):
                    found = [digest(c) for c in chunks]
                    flags = [suspected(d) for d in found]
                    if any(flags):
                        own = (batch.key.iloc[start + i], batch.row.iloc[start + i])
                        for n, (c, d, f) in enumerate(zip(chunks, found, flags, strict=True)):
                            rows.append((*own, n, *((d, c) if f else (None, None)), *_said(None if f else e.piece(c))))
                yield pd.DataFrame(rows, columns=["key", "row", "n", "digest", "chunk", *_PIECE], dtype=object)

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            yield pd.DataFrame([(d, *_said(e.piece(bytes(c)))) for d, c in zip(batch.digest, batch.chunk, strict=True)], columns=["digest", *_PIECE])

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, row, own, pieces = encoder(path), None, None, []
        for batch in batches:
            out = []
            for key_, row_, ids, head, tail, n_head, n_tail, solid, after, before in zip(*(batch[c] for c in ("key", "row", *_PIECE)), strict=True):
                if row_ != row and pieces:
                    out.append((own, *e.finished(e.join(iter(pieces)), outputs)))
                    pieces = []
                row, own = row_, key_
                pieces.append(Piece(np.frombuffer(ids, "<u4"), bytes(head), bytes(tail), int(n_head), int(n_tail), bool(solid), list(map(bytes, after)), list(map(bytes, before))))
            yield pd.DataFrame(out, columns=["key", *names], dtype=object)
        if pieces:
            yield pd.DataFrame([(own, *e.finished(e.join(iter(pieces)), outputs))], columns=["key", *names], dtype=object)

    # Ids travel as text: pandas makes floats of long columns with nulls, which do not hold every id.
    docs = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    parts = saved(numbered.mapInPandas(apart, f"key string, row long, n int, digest binary, chunk binary, {_PIECES}"))
    codes = parts.where("chunk is not null").groupBy("digest").agg(F.first("chunk").alias("chunk")).mapInPandas(once, f"digest binary, {_PIECES}")
    columns = ["key", "row", "n", *_PIECE]
    placed = parts.where("chunk is not null").select("key", "row", "n", "digest").join(codes, "digest").select(columns)
    ordered = placed.unionByName(parts.where("chunk is null").select(columns)).repartition("row").sortWithinPartitions("row", "n")
    joined = ordered.drop("n").mapInPandas(assemble, f"key string, {result}")
    return docs.mapInPandas(alone, f"key string, {result}").unionByName(joined).select(F.col("key").cast(kind).alias(key), *names)
