"""The pipeline against a plain version of it, stage by stage, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_documents import model_fingerprint, plain_model, plain_score
from tracksmith.llm import quality

SF = "/root/testdata/sf0.001"


def plain_topic(t):
    if 8 * len(re.findall(r"[!-@\[-`{-~]", t)) > len(t):
        return "symbols"
    if 4 * len(re.findall("[A-Z]", t)) > len(t):
        return "capitals"
    return "lines" if 100 * t.count("\n") > len(t) else "prose"


def plain_rates(rows, smoothing, keep):
    """Chance of each cell, by loops over a dictionary of cells: 30 rounds of scaling, then cells that are used up one by one."""
    tokens = {}
    for *cell, n in rows:
        tokens[tuple(cell)] = tokens.get(tuple(cell), 0) + n
    total = sum(tokens.values())
    share = {c: n / total for c, n in tokens.items()}
    sums = lambda k: {v: sum(x for c, x in share.items() if c[k] == v) for v in {c[k] for c in share}}
    goals = [{v: x**e for v, x in sums(k).items()} for k, e in enumerate(smoothing)]
    goals = [{v: x / sum(g.values()) for v, x in g.items()} for g in goals]
    for _ in range(30):
        for k, goal in enumerate(goals):
            now = sums(k)
            share = {c: x * goal[c[k]] / now[c[k]] for c, x in share.items()}
    left, room, out = dict(share), keep * total, {}
    while left:
        scale = room / sum(left.values())
        first = max(left, key=lambda c: left[c] / tokens[c])
        if scale * left[first] / tokens[first] <= 1:
            return out | {c: scale * x / tokens[c] for c, x in left.items()}
        out[first], room = 1.0, room - tokens[first]
        del left[first]
    return out


def plain_run():
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    s = quality.Settings()
    known = docs.merge(labels[[zlib.crc32(str(i).encode()) % 3 != 1 for i in labels.doc_id]], on="doc_id").sort_values("doc_id")
    model = plain_model([(t, y, 1.0) for t, y in zip(known.text, known.quality, strict=True)], s)
    scores = {t: plain_score(t, model, s) for t in set(docs.text)}
    assert min(abs(x - 0.5) for x in scores.values()) > 1e-4  # none is near enough to fall on either side by rounding
    docs = docs[[scores[t] >= 0.5 for t in docs.text]].sort_values("doc_id")
    docs = docs[~pd.Series([re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in docs.text], index=docs.index).duplicated()]
    prints, gone, root = [model_fingerprint(t, 3) for t in docs.text], [], list(range(len(docs)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    gone = [root[i] != i for i in range(len(docs))]
    docs = docs[~np.array(gone)]
    cells = list(zip(docs.source, docs.lang, [plain_topic(t) for t in docs.text], [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text], strict=True))
    rates = plain_rates(cells, [corpus_pipeline.SMOOTHING[m] for m in ("source", "lang", "topic")], corpus_pipeline.KEEP)
    chance = np.array([rates[c[:3]] for c in cells])
    draw = [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in docs.doc_id]
    docs = docs[np.array(draw) < chance]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {int(i): t.encode(x, add_special_tokens=False).ids for i, x in zip(docs.doc_id, docs.text, strict=True)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_pipeline_is_its_plain_version(spark):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    want = plain_run()
    assert got == want
    assert len(got) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_last_stage_encodes_and_decodes(spark, nasty, rows):
    """As the library does, whether a text shares chunks with others or not."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [t.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    got = corpus_pipeline.token_ids(spark, nasty, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    want = Counter((r.doc_id, len(i), tuple(i), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(rows, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in got.collect()) == want
