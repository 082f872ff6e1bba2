"""DuckDB twins of the registered queries."""

from threatloom.llm import credentials

REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
),
read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
fates AS (
  SELECT read.*, xor(list_reduce(
      list_transform(range(1, length(key) + 1), lambda k: ascii(substr(key, k, 1))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS what
  FROM read, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fates) WHERE what <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM damaged
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k FROM numbered),
judged AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
    left(coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), ''), 1) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN k > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
opened(s, now, extra, lines, cost) AS (VALUES
  ('0', '0', '', '', 0), ('0', 'u', 'I', chr(10) || 'user:', 2), ('0', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4),
  ('s', 's', '', '', 0), ('s', 'u', 'I', chr(10) || 'user:', 2), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4),
  ('u', 'u', '', '', 0), ('u', 'a', 'I', chr(10) || 'assistant:', 2), ('a', 'a', '', '', 0), ('a', 'u', 'I', chr(10) || 'user:', 2)
),
moves(now, edit, initial, after, cost) AS (VALUES
  ('0', 'D', NULL, '0', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3),
  ('0', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2), ('a', 'R', NULL, 'u', 2),
  ('0', 'K', 's', 's', 0), ('0', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0)
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS s, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM figures
  UNION ALL
  SELECT w.conv_id, j.i, m.after, min({
      'cost': (w.best).cost + o.cost + m.cost + CASE WHEN j.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END,
      'audit': (w.best).audit || o.extra || m.edit,
      'lines': (w.best).lines || o.lines || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text
        ELSE chr(10) || CASE m.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text END})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
  JOIN opened o ON o.s = w.s JOIN moves m ON m.now = o.now
    AND (m.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (m.edit <> 'K' OR m.initial = j.initial)
  GROUP BY w.conv_id, j.i, m.after
),
ended AS (
  SELECT w.conv_id, min({'cost': (w.best).cost + o.cost, 'audit': (w.best).audit || o.extra, 'lines': (w.best).lines || o.lines}) AS best
  FROM walk w JOIN figures f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
  JOIN opened o ON o.s = w.s AND (o.now = 'a' OR (o.now = '0' AND w.s = '0')) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce((best).cost, 0)::BIGINT AS cost, coalesce((best).audit, '') AS audit,
  sha256(coalesce(substr((best).lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
corpus AS (SELECT count(*) AS N, sum(len(terms))::BIGINT AS L FROM docs WHERE len(terms) > 0),
asked AS (SELECT item, item_id, term, count(*) AS n FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
held AS (
  SELECT row, doc_id, term, m, count(*) AS tf
  FROM (SELECT row, doc_id, 25 + (75 * len(terms) * N) // L AS m, unnest(terms) AS term FROM docs, corpus) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term
),
scores AS (
  SELECT item, item_id, row, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _places(kind: int, pattern: str, good: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT row, {kind} AS kind, i, length(gaps[i]) AS gap, length(found[i]) AS size, {good} AS good
  FROM (SELECT row, regexp_extract_all(text, '{quoted}') AS found, regexp_split_to_array(text, '{quoted}') AS gaps,
    regexp_extract_all(text, '{quoted}', {2 if kind in (0, 3) else 0}) AS value FROM docs), unnest(range(1, len(found) + 1)) AS t(i)"""


_MIXED = "regexp_matches(found[i], '[a-z]') AND regexp_matches(found[i], '[A-Z]') AND regexp_matches(found[i], '[0-9]')"
_IN_REACH = f"o.row = p.row AND o.scope = p.scope AND abs(o.start - p.start) <= {credentials.REACH}"

CREDENTIALS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join((
    _places(0, credentials.ASSIGN, f"length(value[i]) >= {credentials.LEAST_VALUE}"), _places(1, credentials.ACCESS), _places(2, credentials.HEX),
    _places(3, credentials.IDENTIFIER, f"length(value[i]) >= {credentials.LEAST_IDENTIFIER}"), _places(4, credentials.KEY, _MIXED),
    _places(5, credentials.ENDPOINT), _places(6, credentials.EMPTY_LINE),
))}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY row, kind ORDER BY i) AS ends FROM matches),
good_parts AS (SELECT row, kind, (ends - size)::BIGINT AS start, ends::BIGINT AS ends FROM placed WHERE good),
scoped AS (
  SELECT *, count(*) FILTER (kind = 6) OVER earlier AS scope,
    max(CASE WHEN kind IN (0, 1, 2, 5) THEN ends END) OVER (PARTITION BY row ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid
  FROM good_parts WINDOW earlier AS (PARTITION BY row ORDER BY start, kind)
),
parts AS (SELECT * FROM scoped WHERE kind <> 6 AND (kind <> 4 OR coalesce(solid, 0) <= start)),
judged AS (
  SELECT *, EXISTS (SELECT 1 FROM parts o WHERE {_IN_REACH} AND o.kind IN (0, 2, 4)) AS secret,
    EXISTS (SELECT 1 FROM parts o WHERE {_IN_REACH} AND o.kind IN (1, 3)) AS identifier,
    EXISTS (SELECT 1 FROM parts o WHERE {_IN_REACH} AND o.kind = 5) AS endpoint
  FROM parts p
),
reported AS (
  SELECT row, kind, start, ['assign', 'access', 'hex', 'identifier', 'key', 'endpoint'][kind + 1] || ':' || start || ':' || ends AS span
  FROM judged WHERE kind < 3 OR (kind = 3 AND secret) OR (kind = 4 AND (identifier OR endpoint)) OR (kind = 5 AND secret AND identifier)
),
joined AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM reported GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row)
"""
