"""op7: the class of every line of every document."""

from __future__ import annotations

from .common import table
from .line_dedup import line_classes


def op7_line_dedup(spark, sf_dir):
    return line_classes(table(spark, sf_dir, "documents")).drop("row")


_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍáàâîôûÁ"
#: DuckDB's levenshtein() counts bytes: each letter of two bytes becomes a control character, of which texts hold none.
_SINGLE = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)])

ORACLE = rf"""
WITH RECURSIVE every_line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no::INT AS line_no, line FROM every_line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (
  SELECT line, length(line) AS n, count(*) AS n_copies, min({{'no_id': doc_id IS NULL, 'doc_id': doc_id, 'line_no': line_no}}) AS first,
         translate(line, '{_LETTERS}', {_SINGLE}) AS t, row_number() OVER (ORDER BY line) AS id FROM lines GROUP BY line),
-- of two edits, one of three pieces of the shorter line is spared; it stands at most two places off in the longer one
pieces AS (SELECT id, n, k, substring(line, 1 + k * (n // 3), n // 3) AS p FROM d, range(0, 3) v(k) WHERE n >= 16),
moved AS (
  SELECT id, n - less AS n, k, substring(line, 1 + k * ((n - less) // 3) + m, (n - less) // 3) AS p FROM d, range(0, 3) v(k), range(0, 3) w(less), range(-2, 3) x(m)
  WHERE n - less >= 16 AND k * ((n - less) // 3) + m >= 0),
-- a stretch of a sixteenth leaves 45 hundredths at the beginning or end
ends AS (SELECT id, n, k, CASE k WHEN 0 THEN left(line, 45 * n // 100) ELSE right(line, 45 * n // 100) END AS p FROM d, range(0, 2) v(k) WHERE n >= 48),
longer AS (
  SELECT id, m AS n, k, CASE k WHEN 0 THEN left(line, 45 * m // 100) ELSE right(line, 45 * m // 100) END AS p
  FROM (SELECT *, unnest(range(greatest(n - n // 16, 48), n + 1)) AS m FROM d WHERE n >= 48), range(0, 2) v(k)),
candidates AS (
  SELECT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM pieces a JOIN moved b ON a.n = b.n AND a.k = b.k AND a.p = b.p AND a.id <> b.id
  UNION
  SELECT least(a.id, b.id), greatest(a.id, b.id) FROM ends a JOIN longer b ON a.n = b.n AND a.k = b.k AND a.p = b.p AND a.id <> b.id),
sides AS (
  SELECT a.id AS a, b.id AS b, a.line AS x, b.line AS y, a.t AS tx, b.t AS ty, least(a.n, b.n) AS n, greatest(a.n, b.n) AS m FROM candidates JOIN d a ON a.id = candidates.x JOIN d b ON b.id = candidates.y),
links AS (
  SELECT a, b FROM sides WHERE CASE
    WHEN n >= 48 AND m - n <= n // 16 AND len(list_filter(range(0, n + 1), lambda p: greatest(m - n // 16 - p, 0) + p <= n AND left(x, p) = left(y, p)
      AND right(x, greatest(m - n // 16 - p, 0)) = right(y, greatest(m - n // 16 - p, 0)))) > 0 THEN true
    WHEN m - n <= least(2, n // 16) THEN levenshtein(tx, ty) <= least(2, n // 16) ELSE false END),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
heads AS (SELECT r.id, min(d.first) AS head FROM reach r JOIN d ON d.id = r.other GROUP BY r.id),
degrees AS (SELECT a AS id, count(*) AS n_links FROM edges GROUP BY a)
SELECT l.doc_id, l.line_no, coalesce(head, first).doc_id AS class_doc_id, coalesce(head, first).line_no AS class_line_no, coalesce(n_links, 0)::BIGINT AS n_links, n_copies::BIGINT AS n_copies,
       l.doc_id IS NOT DISTINCT FROM coalesce(head, first).doc_id AND l.line_no = coalesce(head, first).line_no AS kept
FROM lines l JOIN d ON d.line = l.line LEFT JOIN heads USING (id) LEFT JOIN degrees USING (id)
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": ORACLE}
