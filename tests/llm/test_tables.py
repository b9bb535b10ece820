from __future__ import annotations

import random

import numpy as np
import pytest

from tracksmith.llm import chat, topk


def model_chats(rows):
    found = {}
    for c, turn, role, text in {tuple(r) for r in rows}:
        if c is not None:
            found.setdefault(c, set()).add((turn, role or "unknown", text or ""))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode())
    whole = {c: tuple(x[1:] for x in sorted(t, key=order)) for c, t in found.items()}
    kept = {}
    for c, t in sorted(whole.items()):
        if not any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            kept.setdefault(t, [c, 0])[1] += 1
    return {c: (len(t), n) for t, (c, n) in kept.items()}


def test_chats(spark):
    rng, rows = random.Random(3), []
    base = [[("user" if i % 2 == 0 else "assistant", f"t{k}-{i}") for i in range(6)] for k in range(5)]
    for c in range(40):
        cut = rng.randint(1, 6)
        rows += [(c, i, role, text) for i, (role, text) in enumerate(rng.choice(base)[:cut])]
    rows += [(50, 0, None, None), (51, 3, "user", ""), (51, 9, "user", "<|im_end|> x"), (None, 0, "user", "lost"), (52, None, "user", "a"), (52, 1, "user", "b"), *rows[:3]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = frame.selectExpr("*", "1 AS turns", "2 AS copies", "3 AS place", "4 AS t").repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(wide).collect()}
    assert {c: (r.n_turns, r.n_copies) for c, r in got.items()} == model_chats(rows)
    assert got[50].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[51].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>user\n< |im_end| > x<|im_end|>\n"
    assert got[52].rendered.startswith("<|im_start|>user\na<|im_end|>")
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chats_of_equal_content_leave_the_smallest(spark):
    frame = spark.createDataFrame([(c, t, "user", f"x{t}") for c in range(300) for t in range(2)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(frame).first()
    assert (row.conv_id, row.n_turns, row.n_copies) == (0, 2, 300)


def test_chats_with_two_texts_in_one_turn(spark):
    """[b] is no prefix of [a, b, z], whatever the letters: turns are told apart by their texts, not by hashes of these."""
    for a, b in (("a", "b"), ("c", "d"), ("e", "f"), ("x", "y")):
        rows = [(1, 0, "user", b), (2, 0, "user", a), (2, 0, "user", b), (2, 1, "user", "z"), (3, 0, "user", a)]
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
        assert set(got) == {1, 2}
        assert got[2].rendered == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in (a, b, "z"))
        assert model_chats(rows) == {c: (r.n_turns, r.n_copies) for c, r in got.items()}


def brute(vectors, every, k):
    out = []
    for i, (q, a) in enumerate(vectors):
        if q % every == 0:
            scores = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), c) for j, (c, b) in enumerate(vectors) if j != i and len(a) == len(b))
            out += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("size", "places"), [(1 << 16, 256), (40, 256), (40, 3), (25, 1)])
def test_top_k(spark, size, places, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", size)
    monkeypatch.setattr(topk, "PLACES", places)
    monkeypatch.setattr(topk, "FIRST_PLACES", 2)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.2, (6, 12))
    found = [(i, (centres[i % 6] + rng.normal(0, 0.05, 12)).tolist()) for i in range(400)]
    found += [(1000 + i, [0.5] * 12) for i in range(60)]  # ties
    found += [(2000, None), (2050, [0.1, None, *[0.1] * 10]), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (None, [0.1] * 12), (3000, [0.25, 0.5]), (3001, [0.75, 0.5])]
    found += [(0, found[0][1]), (0, [0.9] * 12), (7, [2.0] * 12), (7, [-2.0] * 12)]  # rows that share an id
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in found], "vec_id long, embedding array<double>, id int, v int").repartition(4)
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in found if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, every=10, k=5).collect())
    assert got == brute(ok, 10, 5)
    if size > 40:
        assert topk.top_k(frame.limit(0)).count() == 0


def test_a_query_is_not_sent_where_it_cannot_score(spark, monkeypatch):
    """Tight, far places: the first shard's k-th score keeps queries out of all but few others."""
    monkeypatch.setattr(topk, "SHARD", 50)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 2.0, (20, 16))
    found = [(i, (centres[i % 20] + rng.normal(0, 0.01, 16)).tolist()) for i in range(2400)]
    frame = spark.createDataFrame(found, "vec_id long, embedding array<double>")
    _, places = topk.deal(topk.saved(topk.quantised(frame)), 48)
    queries = np.floor(256 * np.array([v for _, v in found[::50]])).astype(np.int64)
    number, reach = places.reach(queries)
    own = places.nearest(queries)[0]
    scores = [np.sort(queries @ np.floor(256 * np.array([v for _, v in found])).astype(np.int64).T, axis=1)[:, -6]]
    assert (reach >= scores[0][:, None]).mean() < 0.4
    assert all(reach[i, np.flatnonzero(number == own[i])] >= scores[0][i] for i in range(len(queries)))


def test_products_stay_exact():
    a = np.array([[1 << 40, 3]], np.int64)
    b = np.array([[1 << 20, 5], [1 << 40, 1]], np.int64)
    assert topk.products(a, b).tolist() == [[(1 << 60) + 15, np.iinfo(np.int64).max]]
