"""DuckDB twins of the registered queries on documents: windows, metrics and links written out as plain relations."""

from threatloom.llm import decontamination, ngram_join, substring_dedup

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows(size: int | str) -> str:
    """Places and texts of a table's windows: words hold no blank, so joined words tell windows apart."""
    return f"array_to_string(words[i:i + {size} - 1], ' ') AS w"


_WINDOW = substring_dedup.WINDOW

REPEATS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_SPACED.format("coalesce(text, '')")} AS words FROM documents),
wins AS (SELECT row, doc_id, i, {_windows(_WINDOW)} FROM docs, unnest(range(1, len(words) - {_WINDOW - 2})) AS t(i)),
late AS (SELECT row, i FROM (SELECT row, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT row, i + k AS i FROM late, range({_WINDOW}) AS t(k)),
kept AS (
  SELECT row, count(*) AS n, string_agg(words[i], ' ' ORDER BY i) AS text
  FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM docs) ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
"""

_COUNT = "length(regexp_replace(text, '[^{}]', '', 'g'))"

RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS words FROM documents),
wins AS (SELECT row, i, {_windows(5)} FROM docs, unnest(range(1, len(words) - 3)) AS t(i)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS k FROM wins) WHERE k > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY row),
metrics AS (
  SELECT doc_id, text, len(words) AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {_COUNT.format("#*$%&|<>")}::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines,
    len(list_distinct(words)) AS n_distinct, coalesce(n, 0) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (row)
),
judged AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM metrics
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 2 * {_COUNT.format("A-Z")} > word_chars OR 100 * {_COUNT.format("!?")} > 10 * word_chars
    OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 100 * n_dup_lines > 50 * len(lines)
    OR (n_words >= 50 AND 10 * n_distinct < n_words)) AS kept
FROM judged
"""

_READ = _ALNUM.format(_LOWER.format("coalesce(text, '')"))
_PHRASE = decontamination.WINDOW

BENCHMARK_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_READ} AS words FROM documents),
items AS (SELECT item_id, words, least(len(words), {_PHRASE}) AS size FROM (SELECT item_id, {_READ} AS words FROM benchmark) WHERE len(words) > 0),
phrases AS (SELECT DISTINCT item_id, size, {_windows("size")} FROM items, unnest(range(1, len(words) - size + 2)) AS t(i)),
sizes AS (SELECT DISTINCT size FROM phrases),
wins AS (SELECT row, size, i, {_windows("size")} FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(i)),
found AS (SELECT row, size, i, item_id FROM wins JOIN phrases USING (size, w)),
hit AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, i, unnest(range(size)) AS k FROM found) GROUP BY row),
held AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""

_SHINGLE = ngram_join.WORDS
_COMMON = "len(list_intersect(a.grams, b.grams))"

JOIN_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_SPACED.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents
),
grams AS (
  SELECT DISTINCT row, {_windows(f"least(len(words), {_SHINGLE})")}
  FROM docs, unnest(range(1, greatest(len(words) - {_SHINGLE - 2}, 2))) AS t(i) WHERE len(words) > 0
),
sets AS (SELECT row, list(w ORDER BY w) AS grams FROM grams GROUP BY row),
classes AS (SELECT min(row) AS class, grams FROM sets GROUP BY grams),
members AS (SELECT row, class FROM sets JOIN classes USING (grams)),
-- Of two similar sets, each one's rarest quarter and one more shingles hold a common one.
ranked AS (
  SELECT class, w, row_number() OVER (PARTITION BY class ORDER BY df, w) AS place, n
  FROM (SELECT class, w, len(grams) AS n, count(*) OVER (PARTITION BY w) AS df FROM (SELECT class, grams, unnest(grams) AS w FROM classes))
),
shown AS (SELECT class, w FROM ranked WHERE 100 * (place - 1) <= {100 - ngram_join.PERCENT} * n),
pairs AS (SELECT DISTINCT a.class AS a, b.class AS b FROM shown a JOIN shown b ON a.w = b.w AND a.class < b.class),
links AS (
  SELECT a.class AS a, b.class AS b FROM pairs p JOIN classes a ON a.class = p.a JOIN classes b ON b.class = p.b
  WHERE 100 * {_COMMON} >= {ngram_join.PERCENT} * (len(a.grams) + len(b.grams) - {_COMMON})
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT class AS a, class AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
),
least AS (SELECT r.a AS class, min(doc_id) AS component_id FROM reach r JOIN members m ON m.class = r.b JOIN docs USING (row) GROUP BY r.a)
SELECT doc_id, coalesce(len(grams), 0) AS n_shingles, CASE WHEN grams IS NULL THEN doc_id ELSE component_id END AS component_id
FROM docs LEFT JOIN sets USING (row) LEFT JOIN members USING (row) LEFT JOIN least USING (class)
"""
