"""op10: mixing all documents to target weights."""

from __future__ import annotations

from .common import table
from .mixing import mix


def op10_mixing(spark, sf_dir):
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '?' || text, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank FROM src),
weighed AS (SELECT *, ([5, 2, 1])[(source_rank % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS rest_w
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fitted AS (SELECT *, rest::DOUBLE / rest_w AS lvl, cap >= rest::DOUBLE / rest_w * w AS fits FROM levels),
chosen AS (SELECT lvl AS final FROM fitted WHERE fits ORDER BY cap / w, source_rank LIMIT 1),
targets AS (
  SELECT source, source_size, source_rank,
         least(CASE WHEN fits THEN (SELECT final FROM chosen) * w ELSE cap::DOUBLE END, cap::DOUBLE) AS target FROM fitted),
ranked AS (
  SELECT b.*, t.source_size, t.target, t.source_rank,
         sum(size) OVER (PARTITION BY t.source_rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, h, size, source_rank, (e * source_size + cum)::DOUBLE / target AS ends
  FROM ranked, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY ends, source_rank, h, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
takes AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM ordered
  WHERE upto <= (SELECT sum(size) FROM base) GROUP BY doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM ranked r LEFT JOIN takes t ON r.doc_id IS NOT DISTINCT FROM t.doc_id
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": ORACLE}
