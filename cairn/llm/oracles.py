"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_REACH = """reach AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT reach.a, both_ways.b FROM reach JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) both_ways ON reach.b = both_ways.a),
roots AS (SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a)"""

JACCARD_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON id = doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS raw, list_max(list_transform(raw, lambda x: abs(x))) AS top FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
), good AS (
  SELECT vec_id, label, list_transform(raw, lambda x: x / top) AS e FROM v WHERE len(list_filter(raw, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND top > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98
), {_REACH}, n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN roots ON roots.id = vec_id LEFT JOIN n ON n.id = vec_id
"""


def _text(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '')"


def _mask(turns: str) -> str:
    ends = f"list_transform(range(1, len({turns}) + 1), lambda i: CAST(coalesce(list_sum(list_transform({turns}[1:i], lambda t: 24 + length(t.role) + length(t.text))), 0) AS INTEGER))"
    return f"list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: {{'begin': CAST({ends}[i] - 11 - length({turns}[i].text) AS INTEGER), 'end': {ends}[i]}})"


CHAT_FORMAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY 1
), l AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM c
), p AS (SELECT l.conv_id, l.turns AS chosen, CASE WHEN l.last IS NULL THEN l.turns
    WHEN o.last IS NOT NULL THEN list_transform(l.turns, lambda x, i: CASE WHEN i = l.last THEN o.turns[o.last] ELSE x END) ELSE [] END AS rejected
  FROM l LEFT JOIN l o ON o.conv_id = xor(l.conv_id, 1)
), n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) AS n_prefix FROM p
), s AS (SELECT conv_id, chosen, rejected, n_prefix, chosen[1:n_prefix] AS head, chosen[n_prefix + 1:] AS a, rejected[n_prefix + 1:] AS b FROM n)
SELECT conv_id, CAST(n_prefix AS INTEGER) AS n_prefix, {_text('head')} AS prompt, {_text('a')} AS chosen_completion, {_mask('a')} AS chosen_mask,
  {_text('b')} AS rejected_completion, {_mask('b')} AS rejected_mask,
  CASE WHEN len(chosen) = 0 OR len(rejected) = 0 THEN 'one_sided' WHEN len(a) = 0 AND len(b) = 0 THEN 'identical' ELSE 'ok' END AS status
FROM s
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def _crc(bytes_: str) -> str:
    """crc32 of a list of bytes: a step a bit."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda s, b: xor(s >> 8, steps[1 + (xor(s, b) & 255)])), 4294967295)"


SPELLING_VARIANTS = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT byte, {_STEP}, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents
), each AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL
), hashed AS (
  SELECT w, n, {_crc("flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))")} AS h FROM each, steps
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS gap, word[:i - 1] || word[i + 1:] AS less FROM places
), pairs AS (
  SELECT x.word, y.word AS near, y.n FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.less = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.less = y.word
), best AS (
  SELECT p.word, count(*) AS n_near, max(p.n) AS near_n, arg_min(p.near, (-p.n, p.near)) AS near FROM pairs p GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.at WHERE form IS NOT NULL
), ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d
), terms AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM terms GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30
), counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1
), whole AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (w.n + 5 * v.v)::HUGEINT AS BIGINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN whole w ON w.lang = g.lang AND w.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + CAST(1000000000 * (sum(c.n) + 5)::HUGEINT // (any_value(t.n) + 5 * any_value(v.v))::HUGEINT AS BIGINT) AS q
  FROM kept k JOIN v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM whole GROUP BY 1) t ON t.lang = k.lang JOIN counts c ON c.lang = k.lang AND c.term = k.term GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), term AS (SELECT p.lang, source, p.term AS item, p - q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

NEAREST = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), found AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM found)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {"op2_jaccard_join": JACCARD_JOIN, "op6_chat_format": CHAT_FORMAT, "op8_embedding_dedup": EMBEDDING_DEDUP, "op11_spelling_variants": SPELLING_VARIANTS, "op12_source_divergence": SOURCE_DIVERGENCE, "op13_nearest": NEAREST}
