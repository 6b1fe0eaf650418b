"""The queries' results in SQL, where SQL can express them. Fixed patterns are written without look-around here."""

from __future__ import annotations

from changeflow.llm import mixing, ngram_join
from changeflow.llm.common import WORD
from changeflow.llm.queries import CONTROL

CONVERSATIONS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
h AS (SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE length(role) + 2 END AS n,
  length(text) + len(regexp_extract_all(text, '### |</turn>')) AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + n + 2 + body + 9)::BIGINT AS formatted_chars
FROM h GROUP BY conv_id
"""

#: kind, order, pattern, condition on the match m.
_SECRETS = [
    ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""),
    ("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", 2, "[0-9a-f]+", "length(m) >= 32"),
    ("jwt", 3, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("forge", 4, "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("chat", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("pem", 6, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
]


def _found(kind: str, order: int, pattern: str, ok: str) -> str:
    hits = f"SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS p, regexp_extract_all(coalesce(text, ''), '{pattern}') AS h FROM documents"
    each = "SELECT doc_id, h[i] AS m, list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i - 1]]), 0) AS s FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (" + hits + "))"
    return f"SELECT doc_id, '{kind}' AS kind, {order} AS k, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM ({each}) WHERE {ok}"


SECRETS = f"""
WITH f AS ({' UNION ALL '.join(_found(*x) for x in _SECRETS)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {ngram_join.WORDS} THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + {ngram_join.WORDS - 1}], ' ') for i in range(1, len(ws) - {ngram_join.WORDS - 2})] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c.n >= {ngram_join.THRESHOLD} * (x.n + y.n - c.n) - 1e-9),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
k AS (SELECT doc_id, min(reached) AS class_id, count(*) AS n_class FROM r GROUP BY doc_id)
SELECT k.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = k.doc_id) AS n_links, n_class FROM k
"""

NEAREST = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score, a.r FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
"""

_FIT = "CASE WHEN (ceil(exact - 1e-9) - exact) * greatest(size, 1) <= spent THEN ceil(exact - 1e-9) ELSE floor(exact + 0.5) END"
_PASSES = "".join(
    f"""o{k} AS (SELECT *, target - sum(size * given) OVER (PARTITION BY source) AS off FROM g{k}),
r{k} AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(n, CASE WHEN off > 0 THEN 3 * n - given ELSE given END) END AS room FROM o{k}),
s{k} AS (SELECT *, coalesce(sum(size * room) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, (abs(off) - spent) / greatest(size, 1) AS exact FROM r{k}),
g{k + 1} AS (SELECT * EXCLUDE (off, room, spent, exact, given), (given + sign(off) * greatest(least({_FIT if k < mixing.PASSES - 1 else 'floor(exact + 0.5)'}, room), 0))::BIGINT AS given FROM s{k}),
"""
    for k in range(mixing.PASSES)
)

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS words, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, words * 3.0::DOUBLE / weight AS ratio FROM w),
v AS (SELECT *, (sum(words) OVER () - 3.0::DOUBLE * coalesce(sum(words) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM o
  WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, words, CASE WHEN ratio <= level THEN words * 3.0::DOUBLE ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target FROM v),
r AS (SELECT *, CASE WHEN words > 0 THEN least(round(target / words, 9), 3.0)::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM t),
i AS (SELECT d.source, size, words, target, rate, count(*) AS n FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source GROUP BY ALL),
j AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM i),
g0 AS (SELECT *, floor((ahead + n) * rate + 0.5 + 1e-9)::BIGINT - floor(ahead * rate + 0.5 + 1e-9)::BIGINT AS given FROM j),
{_PASSES}
k AS (SELECT d.*, g.words, g.target, g.n, g.given, row_number() OVER (PARTITION BY d.source, d.size ORDER BY d.doc_id) - 1 AS rank FROM d JOIN g{mixing.PASSES} g ON d.source IS NOT DISTINCT FROM g.source AND d.size = g.size),
x AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE given // n + CASE WHEN rank < given % n THEN 1 ELSE 0 END END::BIGINT AS copies FROM k)
SELECT doc_id, size, words AS source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken, source, copies FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_conversations": CONVERSATIONS, "op6_secret_scan": SECRETS, "op8_near_duplicates": NEAR_DUPLICATES, "op9_nearest": NEAREST, "op10_mixing": MIXING}
