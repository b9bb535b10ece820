"""Operators over a whole corpus, each against a plain version."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracksmith.llm import alignment, search, suffixes


def found_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    """(id, text) pairs in both; (item, rank, doc, score)."""
    own = [(d, Counter(found_terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    total, length = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        asked = found_terms(text)
        for d, c, n in own:
            m, s = 25 + 75 * n * total // length, 0
            for t in asked:
                if c[t]:
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize(("cells", "run", "item_bytes"), [(1 << 22, 1 << 20, 1 << 19), (2048, 50, 2500)])
def test_search(spark, nasty, rows, cells, run, item_bytes, monkeypatch):
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "RUN", run)
    monkeypatch.setattr(search, "ITEM_BYTES", item_bytes)
    rng = random.Random(4)
    texts = [r.text for r in rows if r.text]
    items = [(i, " ".join(rng.sample(texts[10 + i % 30].split(), min(12, len(texts[10 + i % 30].split()))))) for i in range(25)]
    items += [(3, items[5][1]), items[4], (100, None), (101, " .,"), (102, "zzzz"), (None, items[2][1].upper() + " é ñ"), (103, texts[0][:200])]
    frame = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, number int, score int")
    got = search.search(nasty, frame, k=4)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == Counter(plain_search([(r.doc_id, r.text) for r in rows], items, 4))
    assert search.search(nasty.limit(0), frame).count() == 0
    assert search.search(nasty, frame.limit(0)).count() == 0


def test_masks_that_cannot_come_in_are_not_looked_at():
    rng = np.random.default_rng(3)
    parts = rng.integers(1, 1000, (6, 512)) * (rng.random((6, 512)) < 0.5)
    best = search.Best(3)
    looked = search.evaluated(np.packbits(parts > 0, axis=1), parts, np.arange(512), np.zeros(512, np.int64), best)
    want = sorted(zip((-parts.sum(axis=0)).tolist(), range(512), strict=True))[:3]
    assert [(-s, p) for s, p, _ in best.rows.tolist()] == want
    assert looked < 40


def plain_alignment(docs):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each text, by the libraries and loops."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    assert len(letters) == 256
    assert ByteLevel().decode(["Ġaé"[:2]]) == " a"
    rows = []
    for text in docs:
        ends, ids = [], []
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            sizes = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
            if all(b"".join(s) == (" " + text).encode() for s in sizes):
                ends = [list(itertools.accumulate(map(len, s))) for s in sizes]
        groups = []
        if ends:
            both, at = sorted(set(ends[0]) & set(ends[1])), [0, 0]
            for e in both:
                group = []
                for side in (0, 1):
                    n = at[side]
                    while at[side] < len(ends[side]) and ends[side][at[side]] <= e:
                        at[side] += 1
                    group.append(ids[side][n : at[side]])
                groups.append(group)
        rows.append(groups)
    count = Counter(p for groups in rows for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    out = []
    for groups in rows:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


ODD = ["", " ", "  ", " a", "a ", "a  ", " a  b ", "\n", "a \n b", "a　 b", "▁x y", "x ▁", "  z", "<s> </s> <unk> <0x41>", "<|endoftext|> q", "👩‍👩‍👧 ok", "é ́", "=" * 300, "1234567 89", "a" * 3000, "中文字 " * 40, "\x00 b", "﻿a", "ﬁ ①"]


@pytest.mark.parametrize(("part", "keys", "fan", "large"), [(1 << 14, 1 << 22, 32, 4096), (50, 400, 2, 3)])
def test_alignment(spark, nasty, rows, part, keys, fan, large, monkeypatch):
    for name, value in (("PART", part), ("KEYS", keys), ("FAN", fan), ("LARGE", large), ("RUN", 5000)):
        monkeypatch.setattr(alignment, name, value)
    texts = [r.text for r in rows] + ODD
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = nasty.unionByName(extra, allowMissingColumns=True)
    got = alignment.align(docs).collect()
    ids = [r.doc_id for r in rows] + [5000 + i for i in range(len(ODD))]
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == Counter((i, *p) for i, p in zip(ids, plain_alignment(texts), strict=True))


def test_alignment_of_nothing(spark, none):
    assert alignment.align(none).count() == 0
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(frame).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_a_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 31, 5000))
    known, strange = pairs[::2], pairs[1::2]
    made = []
    for p in range(3):
        sizes, bits, order = alignment.hashed(known[alignment.part_of(known, 3) == p])
        made.append(type("Row", (), {"part": p, "sizes": sizes.tobytes(), "bits": np.packbits(bits).tobytes(), "pairs": order.tobytes()}))
    hash_ = alignment.Hash(made, 3)
    assert sorted(hash_.number(known).tolist()) == list(range(len(known)))
    assert (hash_.number(strange) == -1).all()
    assert (alignment.Hash(made[:1], 3).number(known) >= 0).sum() == (alignment.part_of(known, 3) == 0).sum()


def plain_spans(texts, length):
    """(n_bytes, removed runs, what is left) of each text, from all strings of the length."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        runs = []
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        left = b"".join(d[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(d)], strict=True))
        out.append((len(d), runs, left))
    return out


def planted(seed, n, passage):
    """Texts that share passages at all offsets, some of them within themselves, with a template that differs in its middle only."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [noise(passage + rng.randint(-40, 400)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a : len(s) - rng.randint(0, 60)], noise(rng.randint(0, 100))]
        out.append("".join(parts))
    head, tail = noise(90), noise(90)
    out += [noise(rng.randint(0, 80)) + head + f"{i % 23:06d}" * 3 + tail + noise(30) for i in range(60)]
    return [*out, "z" * 500, "z" * 170, "z" * 159, out[0], out[0], None, "", "ab" * 300]


@pytest.mark.parametrize(("batch", "block", "length"), [(1 << 17, 1 << 20, 160), (300, 219, 160), (40, 146, 200)])
def test_repeated_spans(spark, batch, block, length, monkeypatch):
    for name, value in (("BATCH", batch), ("BLOCK", block), ("ROUNDS", 2), ("NAME_ROUNDS", 2)):
        monkeypatch.setattr(suffixes, name, value)
    texts = planted(batch, 60, length)
    rows = [(i if i % 9 else None if i else 5, t, "x", 1, 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, part int, row int").repartition(3)
    got = suffixes.repeated_spans(frame, length=length).collect()
    want = plain_spans(texts, length)
    assert any(w[1] for w in want)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple(zip(r.starts, r.ends, strict=True)), r.kept_sha256) for r in got) == Counter(
        (row[0], n, sum(b - a for a, b in runs), len(runs), tuple(map(tuple, runs)), hashlib.sha256(left).hexdigest()) for row, (n, runs, left) in zip(rows, want, strict=True)
    )
    if length == 200:
        left = suffixes.remove_repeats(frame, length=length)
        assert left.columns == [*frame.columns, "kept"]
        assert Counter((r.doc_id, bytes(r.kept)) for r in left.collect()) == Counter((row[0], w[2]) for row, w in zip(rows, want, strict=True))


def test_repeated_spans_of_odd_rows(spark, nasty, rows, none):
    got = suffixes.repeated_spans(nasty).collect()
    want = plain_spans([r.text for r in rows], 400)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest()) for r, (n, runs, left) in zip(rows, want, strict=True))
    assert suffixes.repeated_spans(none).count() == 0


@pytest.mark.parametrize("r", [1, 2])
def test_a_cover_has_every_difference(r):
    period, places = suffixes.cover(r)
    assert len(places) == 6 * r + 4
    assert {int(a - b) % period for a in places for b in places} == set(range(period))


def test_ties_are_settled_by_names():
    """Strings that agree outside and differ within: equal names at the shift of their places, and only they, tell them equal."""
    rng = np.random.default_rng(2)
    place, kind = rng.integers(0, suffixes.PERIOD, 60), rng.integers(0, 25, 60)
    shifts = suffixes.SHIFTS[place]
    names = (kind[:, None] * 1000 + shifts + 1).astype(np.uint64)  # a window's name is told by its text and where it begins in it
    zero = np.zeros(60, np.uint64)
    counts = Counter(kind.tolist())
    want = [counts[k] > 1 for k in kind.tolist()]
    assert suffixes.alike(place, names).tolist() == want
    repeated, sent = suffixes.settled(zero, zero, place, lambda rows, slots: names[rows, slots])
    other, _ = suffixes.settled(zero, np.arange(60).astype(np.uint64), place, lambda rows, slots: names[rows, slots])
    assert not other.any()  # the second half of the key tells them apart
    assert repeated.tolist() == want
    assert {k for k, s in zip(kind.tolist(), sent, strict=True) if s} == set(counts)


def test_few_suffixes_of_long_repeats_take_part():
    """Of long passages only suffixes near the ends are sorted; with the samples that stand twice they tell all bytes."""
    rng, length = random.Random(5), 400
    noise = lambda k: bytes(rng.choices(range(97, 123), k=k))
    passages = [noise(20_000), noise(9_000), noise(430)]
    texts = [noise(rng.randint(1, 300)).join([b"", *(p[rng.randint(0, 20) :] for p in passages), b""]) for _ in range(3)] + [noise(500)]
    at = [np.array([p for p in range(len(t) - length + suffixes.PERIOD) if p % suffixes.PERIOD in suffixes.COVER]) for t in texts]
    windows = Counter(t[p : p + length - suffixes.PERIOD + 1] for t, own in zip(texts, at, strict=True) for p in own)
    strings = Counter(t[p : p + length] for t, own in zip(texts, at, strict=True) for p in own)
    starts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    numbers = {w: n + 1 for n, w in enumerate(windows)}
    found, asked = [], set()
    for t, own in zip(texts, at, strict=True):
        own = np.array([p for p in own if windows[t[p : p + length - suffixes.PERIOD + 1]] > 1], np.int64)
        called = np.array([numbers[t[p : p + length - suffixes.PERIOD + 1]] for p in own], np.uint64)
        sure = np.array([p + length <= len(t) and strings[t[p : p + length]] > 1 for p in own], bool)
        found.append((own, called, sure))
        asked |= {(c, k) for c, steps in zip(called.tolist(), suffixes.open_steps(own, sure, len(t), length), strict=True) for k in np.flatnonzero(steps).tolist()}
    part = []
    for t, (own, called, sure) in zip(texts, found, strict=True):
        steps = np.array([[(c, k) in asked for k in range(len(suffixes.STEPS) - 1)] for c in called.tolist()], bool).reshape(len(own), len(suffixes.STEPS) - 1)
        off = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in suffixes.suffixes(t, own, called, steps, length, 1, 0))])
        part.append(len(off))
        twice = [p for p in range(len(t) - length + 1) if starts[t[p : p + length]] > 1]
        told = np.array([*own[sure].tolist(), *(p for p in off.tolist() if starts[t[p : p + length]] > 1)], np.int64)
        assert [x.tolist() for x in suffixes.runs(told, length)] == [x.tolist() for x in suffixes.runs(np.array(twice, np.int64), length)]
    assert 0 < 10 * sum(part) < sum(n for n in starts.values() if n > 1)
