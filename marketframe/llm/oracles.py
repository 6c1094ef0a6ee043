"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import decontamination, mixing, near_duplicates, periodic_runs, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(sum(quality.STOP_WORDS.values(), [])))) + "]"

OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, t, ws, len(ws) AS n,
    CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END AS tri FROM w),
placed AS (SELECT doc_id, unnest(tri) AS g, unnest(range(0, len(tri))) AS i FROM win),
twice AS (SELECT doc_id, i FROM placed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT DISTINCT doc_id, i + d AS i FROM twice, (VALUES (0), (1), (2)) v(d)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT win.doc_id, n::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: list_contains({_STOP}, lower(rtrim(x, '.,')))))::BIGINT AS n_stop_words
    FROM win JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.1
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.35) AND n_stop_words / n_words >= 0.06 AS kept,
    n_lines, n_stop_words FROM b
"""


def _escaped(column: str) -> str:
    from .chat import CODES, CONTROL, ESCAPE

    out = f"replace(coalesce({column}, ''), '{ESCAPE}', '{ESCAPE}{CODES[0]}')"
    for code, control in zip(CODES[1:], CONTROL):
        out = f"replace({out}, '{control}', '{ESCAPE}{code}')"
    return out


OP6 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(9 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP7 = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    list_sum(list_transform(range(1, len(a.bits) + 1), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END))::BIGINT AS distance
    FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10
"""

# the threshold is 4/5: shared * 5 >= 4 * (a + b - shared), that is shared * 9 >= 4 * (a + b)
OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {near_duplicates.SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS grams FROM w),
cls AS MATERIALIZED (SELECT md5(array_to_string(grams, chr(10))) AS c, min(doc_id) AS class_id, any_value(grams) AS grams FROM s GROUP BY 1),
g AS (SELECT c, len(grams) AS n, unnest(grams) AS gram FROM cls),
hits AS (SELECT a.c AS c, b.c AS d FROM g a JOIN g b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) * 9 >= 4 * (a.n + b.n)),
reach AS (SELECT c, c AS d FROM cls UNION SELECT r.c, h.d FROM reach r JOIN hits h ON r.d = h.c),
grp AS (SELECT reach.c, min(class_id) AS group_id FROM reach JOIN cls ON reach.d = cls.c GROUP BY reach.c),
links AS (SELECT c, count(*) AS n_links FROM hits GROUP BY c)
SELECT s.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, group_id
FROM s JOIN cls ON cls.c = md5(array_to_string(s.grams, chr(10))) JOIN grp USING (c) LEFT JOIN links USING (c)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
e AS (SELECT *, (1 + length(bin(size)))::DOUBLE AS tilt,
    (('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, 'n'), tie)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(tilt * size) AS tilted,
    ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM e GROUP BY source),
f AS (SELECT *, 3.0 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT *, CASE WHEN level * weight >= cap THEN cap ELSE least(cap, max(CASE WHEN level * weight < cap THEN level END) OVER () * weight) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
p AS (SELECT e.*, r.source_size, r.target, floor(rate) AS whole, target - floor(rate) * r.source_size AS rest,
    CASE WHEN r.source_size > 0 THEN least(1.0, (rate - floor(rate)) * r.source_size / tilted * tilt) ELSE 0.0 END AS p
    FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p <= 0 OR size = 0 THEN 1.0 ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS q FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, tie, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM q)
SELECT doc_id, size, source_size, round(target, 4) AS target,
    (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN seen + size / 2.0 <= rest THEN 1 ELSE 0 END END * size)::BIGINT AS taken FROM o
"""

# crc32 of the decimal doc_id, bit by bit
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, b:
    list_reduce(range(8), lambda y, j: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(acc, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w0, {_CRC} AS h FROM documents),
e AS (SELECT *, len(w0)::BIGINT AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT r, unnest(CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS word,
    unnest(range(0, n)) AS i FROM p),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM isles GROUP BY r, q, isle HAVING count(*) + q >= greatest({periodic_runs.SHORTEST}, 2 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM stretch GROUP BY r, s, len),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM t ANTI JOIN dropped USING (r, i) GROUP BY r),
sums AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY len DESC, s, q) = 1)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
    (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM p LEFT JOIN sums USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_TOKENS} AS ws FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(ws), {decontamination.WINDOW}) AS k, array_to_string(ws[i:i + least(len(ws), {decontamination.WINDOW}) - 1], ' ') AS body
    FROM (SELECT item, ws, unnest(range(1, 2 + greatest(0, len(ws) - {decontamination.WINDOW}))) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS ws FROM documents),
win AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS body
    FROM (SELECT r, ws, k, unnest(range(1, 2 + len(ws) - k)) AS i FROM d JOIN (SELECT DISTINCT k FROM pat) ON len(ws) >= k)),
occ AS (SELECT DISTINCT win.r, win.i, win.k, pat.item FROM win JOIN pat USING (k, body)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

ORACLES = {"op4_quality_rules": OP4, "op6_chat_format": OP6, "op7_hamming_search": OP7, "op8_ngram_jaccard": OP8, "op9_mixing": OP9,
           "op11_periodic_runs": OP11, "op13_decontamination": OP13}
