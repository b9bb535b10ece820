"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: White space that the digests treat as one space.
_SPACE = r"[\x20\x09-\x0D]+"

_OP6 = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

# CRC-32 by its table of 256 remainders, built from the polynomial, and one fold over the text's bytes.
_OP2 = """
WITH RECURSIVE rem(b, v, k) AS (
  SELECT b::BIGINT, b::BIGINT, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END, k + 1 FROM rem WHERE k < 8
), tbl AS (SELECT list(v ORDER BY b) AS t FROM rem WHERE k = 8),
c AS (
  SELECT doc_id, coalesce('1' || source, '0') AS source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, tbl),
m AS (SELECT *, md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || size) AS h,
             ('0x' || substr(md5('42:' || source), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - u) / count(*) OVER (PARTITION BY source) AS part FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY part, source, h, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard,
       (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""

_OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang,
         CASE WHEN len(regexp_extract_all(t, '[!-@\x5B-`{-~]')) * 8 > length(t) THEN 'symbols' WHEN len(regexp_extract_all(t, '[A-Z]')) * 4 > length(t) THEN 'capitals'
              WHEN len(regexp_extract_all(t, '\n')) * 100 > length(t) THEN 'lines' ELSE 'prose' END AS topic,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
found AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM cells),
margin AS (
  SELECT 'source' AS kind, source AS v, pow(sum(share), 0.5::DOUBLE) AS r FROM found GROUP BY ALL
  UNION ALL SELECT 'lang', lang, pow(sum(share), 0.7::DOUBLE) FROM found GROUP BY ALL
  UNION ALL SELECT 'topic', topic, pow(sum(share), 0.8::DOUBLE) FROM found GROUP BY ALL),
target AS (SELECT kind, v, r / sum(r) OVER (PARTITION BY kind) AS goal FROM margin),
start AS (
  SELECT f.*, s.goal AS gs, l.goal AS gl, t.goal AS gt FROM found f
  JOIN target s ON s.kind = 'source' AND s.v IS NOT DISTINCT FROM f.source
  JOIN target l ON l.kind = 'lang' AND l.v IS NOT DISTINCT FROM f.lang
  JOIN target t ON t.kind = 'topic' AND t.v IS NOT DISTINCT FROM f.topic),
fit AS (
  SELECT source, lang, topic, tokens, gs, gl, gt, share, 0 AS k FROM start
  UNION ALL
  SELECT source, lang, topic, tokens, gs, gl, gt, c * (gt / sum(c) OVER (PARTITION BY topic)), k + 1 FROM (
    SELECT *, b * (gl / sum(b) OVER (PARTITION BY lang)) AS c FROM (
      SELECT *, share * (gs / sum(share) OVER (PARTITION BY source)) AS b FROM fit WHERE k < 30))),
raked AS (SELECT source, lang, topic, tokens, share, share / nullif(tokens, 0) AS asked FROM fit WHERE k = 30),
gaps AS (
  SELECT abs(sum(share) - any_value(gs)) AS gap FROM fit WHERE k = 30 GROUP BY source
  UNION ALL SELECT abs(sum(share) - any_value(gl)) FROM fit WHERE k = 30 GROUP BY lang
  UNION ALL SELECT abs(sum(share) - any_value(gt)) FROM fit WHERE k = 30 GROUP BY topic),
ranked AS (SELECT *, row_number() OVER (ORDER BY asked DESC, source, lang, topic) AS rk FROM raked),
scaled AS (
  SELECT *, (0.5::DOUBLE * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(share) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM ranked),
chosen AS (SELECT scale AS by_all FROM scaled WHERE scale * asked <= 1 ORDER BY rk LIMIT 1),
chances AS (SELECT source, lang, topic, share, least(1.0::DOUBLE, by_all * asked) AS chance FROM scaled, chosen)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(c.share, 9) AS cell_share, round(c.chance, 9) AS chance, (SELECT round(max(gap), 9) FROM gaps) AS margin_gap,
       ('0x' || substr(md5('42:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE < c.chance AS kept
FROM d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
"""

_OP7 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
         string_agg(sha256(role || chr(10) || text), ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, turns, prefix FROM o WHERE place = turns GROUP BY turns, prefix),
kept AS (SELECT conv_id, copies FROM whole w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.place < o.turns AND o.place = w.turns AND o.prefix = w.prefix))
SELECT conv_id, count(*) AS n_turns, min(copies) AS n_copies, count(*) FILTER (role = 'assistant') AS n_assistant,
       string_agg('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_', '< |im_'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""


_OP8 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _op10() -> str:
    keys = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    allow = r"^[A-Za-z][A-Za-z_+/=-]*$|^[0-9][0-9_+/=-]*$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i)(example|sample|placeholder|dummy|0123456789)"
    return rf"""
WITH pat(kind, name, re, least) AS (VALUES (0, 'assign', '{assign}', 12), (1, 'access', 'AKIA[A-Z0-9]+', 18), (2, 'hex', '[0-9a-f]+', 16), (3, 'entropy', '[A-Za-z0-9+/_=-]{{20,}}', 20)),
m AS MATERIALIZED (SELECT doc_id, kind, re, least, regexp_extract_all(t, re) AS f, regexp_split_to_array(t, re) AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), pat),
u AS (SELECT doc_id, kind, re, least, i, f[i] AS found, length(g[i]) + length(f[i]) AS step FROM m, unnest(range(1, len(f) + 1)) AS r(i)),
s AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
k AS (SELECT doc_id, kind, (stop - length(found))::BIGINT AS start, stop::BIGINT AS stop, found FROM s
      WHERE length(CASE WHEN kind = 0 THEN regexp_extract(found, re, 2) ELSE found END) >= least),
cand AS (SELECT *, row_number() OVER () AS c, CASE WHEN regexp_matches(found, '^[0-9A-Fa-f]+$') THEN 3.0::DOUBLE WHEN regexp_matches(found, '^[0-9A-Z]+$') THEN 3.3::DOUBLE ELSE 3.6::DOUBLE END AS bits
         FROM k WHERE kind = 3 AND NOT regexp_matches(found, '{allow}')),
win AS (SELECT c, doc_id, start, bits, i, substr(found, i + 1, 20) AS w FROM cand, unnest(range(0, length(found) - 19)) AS r(i)),
cnt AS (SELECT c, doc_id, start, bits, i, ch, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS ch FROM win) GROUP BY ALL),
ent AS (SELECT c, doc_id, start, bits, i, sum(round(n * log2(n) * 1e6)) AS h FROM cnt GROUP BY ALL),
hot AS (SELECT doc_id, 3 AS kind, min(start + i) AS start, max(start + i + 20) AS stop FROM ent WHERE h <= floor(20 * (log2(20) - bits) * 1e6) GROUP BY c, doc_id),
spans AS (SELECT doc_id, kind, start, stop FROM k WHERE kind < 3 UNION ALL SELECT doc_id, kind, start, stop FROM hot),
named AS (SELECT spans.*, name || ':' || start || ':' || stop AS said FROM spans JOIN pat USING (kind))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       count(*) FILTER (kind = 3) AS n_entropy, coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans
FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""

_OP11 = r"""
WITH low AS (SELECT 'abcdefghijklmnopqrstuvwxyz' AS a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS b),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, b, a), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents, low),
has AS (SELECT row, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM has),
item AS (SELECT item_id, unnest(regexp_extract_all(translate(text, b, a), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark), low),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM item GROUP BY ALL),
posted AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM has) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posted, total GROUP BY term),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM posted JOIN weight USING (term) JOIN asked USING (term), total GROUP BY item_id, row),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

# Strings of 400 bytes are 800 hexadecimal digits; each document's bytes are numbered from 0.
_OP13 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT row, doc_id, h, len(h) // 2 AS size FROM d),
w AS (SELECT row, i, md5(substr(h, 2 * i + 1, 800)) AS mark FROM (SELECT row, h, unnest(range(size - 399)) AS i FROM n WHERE size >= 400)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY mark) AS c FROM w) WHERE c > 1),
runs AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 0 ELSE 1 END AS begins FROM twice),
spans AS (SELECT row, min(i) AS a, max(i) + 400 AS b FROM (SELECT row, i, sum(begins) OVER (PARTITION BY row ORDER BY i) AS k FROM runs) GROUP BY row, k),
gaps AS (
  SELECT row, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT row, max(b), NULL FROM spans GROUP BY row),
kept AS (SELECT row, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, size) - a)), '' ORDER BY a) AS left_ FROM gaps JOIN n USING (row) GROUP BY row),
gone AS (SELECT row, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row)
SELECT doc_id, size::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM n LEFT JOIN gone USING (row) LEFT JOIN kept USING (row)
"""


ORACLES = {
    "op1_raked_mixture": _OP1,
    "op2_interleaved_shards": _OP2,
    "op6_heavy_hitter_dedup": _OP6,
    "op7_maximal_chats": _OP7,
    "op8_ball_tree_topk": _OP8,
    "op10_entropy_secrets": _op10(),
    "op11_masked_search": _OP11,
    "op13_cover_suffix_dedup": _OP13,
}
