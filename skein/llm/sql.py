"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS h
  FROM documents),
src AS (
  SELECT source, source_size, rk, ([5, 2, 1])[CAST(rk % 3 AS INT) + 1] AS w FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
    FROM s GROUP BY source)),
tot AS (SELECT CAST(sum(source_size) AS BIGINT) AS t FROM src),
lv AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS lam
  UNION ALL
  SELECT k + 1,
    CAST((SELECT t FROM tot) - (SELECT coalesce(sum(3 * source_size), 0) FROM src WHERE 3 * source_size < lam * w) AS DOUBLE)
      / (SELECT sum(w) FROM src WHERE NOT 3 * source_size < lam * w)
  FROM lv WHERE k < 40),
goal AS (
  SELECT rk, source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT lam FROM lv WHERE k = 40) * w) AS target FROM src),
lay AS (
  SELECT *, sum(target) OVER (ORDER BY rk) - target AS lo0,
         coalesce(sum(target) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM goal),
quota AS (
  SELECT rk, source, source_size, target, t,
         least(131072, CAST(round((lo + target) * 131072 / t) AS BIGINT)) - least(131072, CAST(round(lo * 131072 / t) AS BIGINT)) AS slots,
         (source_size - 1) * 131072 // t + 1 AS blocks
  FROM lay, tot),
pos AS (
  SELECT doc_id, s.source, size, source_size, target, slots // blocks AS q, slots % blocks AS r, t,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM s JOIN quota ON s.source IS NOT DISTINCT FROM quota.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE q * size + greatest(0, least(size, (r * t + 131071) // 131072 - a)) END AS BIGINT) AS taken
FROM pos
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, v.label, (SELECT count(*) FROM pairs WHERE pairs.a = v.vec_id) AS n_links, comp.component_id,
       v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id
"""


_LINES = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM d WHERE text IS NOT NULL),
nb AS (
  SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS i
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT doc_id, i, w, line, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(line, 3) OVER o AS l3
  FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
unit AS (
  SELECT doc_id, i, 1 AS n, [line] AS k FROM win WHERE w >= 10
  UNION ALL SELECT doc_id, i, 4, [line, l1, l2, l3] FROM win WHERE l3 IS NOT NULL),
later AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS c FROM unit) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later),
goneln AS (SELECT nb.doc_id, nb.ln FROM nb JOIN gone USING (doc_id, i)),
per AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.ln) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL), '') AS text
  FROM l LEFT JOIN goneln g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, per.text AS text
FROM d LEFT JOIN per USING (doc_id)
"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS digest FROM p),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) ELSE page_id END AS kept FROM d)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + len(regexp_extract_all(role, '\\|</turn>|###|:'))
                + length(text) + len(regexp_extract_all(text, '\\|</turn>|###'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


_SPELLING = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (
  SELECT w, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END)) AS b
  FROM runs WHERE length(w) >= 7),
hashed AS (
  SELECT w, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
spoilt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.d = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.d = words.word),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs),
formed AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN b END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best ON a = word AND r = 1),
follow AS (
  SELECT word, word AS root, form AS ahead FROM formed
  UNION ALL SELECT follow.word, formed.word, formed.form FROM follow JOIN formed ON formed.word = follow.ahead)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM follow WHERE ahead IS NULL) USING (word)
"""

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _MIX, "op3_embeddings": _VECTORS, "op5_warc": _WARC, "op6_line_dedup": _LINES, "op8_chat": _CHAT, "op11_spelling": _SPELLING, "op13_exact_dedup": _EXACT}
