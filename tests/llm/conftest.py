from __future__ import annotations

import random

import pytest

CLASHING = ("id", "key", "digest", "winner", "size", "row", "text__", "score__", "rank__", "kept", "tokens__", "fp", "gone__", "Source__", "place", "n")


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls everywhere, empty, blank, odd and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "ñ", "é", "Re", "ti"]) for _ in range(rng.randint(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(30)]
    long = " ".join(word() for _ in range(60_000))
    texts = [None, "", " ", "\n\t ", "x", "<|endoftext|>", "á é'll 中文 \x1c 　z", long, long, "Ö" * 20_000, *prose, *prose[:10], prose[0] + " ", prose[1].replace(" ", "\n"), 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [((1 << 62) + 1, prose[3] + " tail", "en", "s1", 9), rows[12], rows[12], (None, prose[2], None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame([(*r, *("c" for _ in CLASHING)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    return frame.repartition(3)


@pytest.fixture(scope="session")
def none(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def rows(nasty):
    return nasty.collect()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)] + [(11, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
