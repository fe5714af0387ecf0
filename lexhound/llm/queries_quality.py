"""op2: rule statistics and the verdict on every document."""

from __future__ import annotations

from .common import materialise, table
from .quality import base_failed, fit, judge, rule_stats


def op2_quality(spark, sf_dir):
    stats = materialise(rule_stats(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-stats")
    forest = fit(stats, table(spark, sf_dir, "labels"))
    return judge(stats, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def quality_statistics(spark, sf_dir):
    """The rule statistics and base rules of op2, without the forest, which SQL can't express."""
    stats = rule_stats(table(spark, sf_dir, "documents"), ["doc_id"])
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


STATISTICS = r"""
WITH base AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base),
windows AS (SELECT id, i, list_slice(w, i, i + 4) AS five FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) v(k) GROUP BY id),
lines AS (SELECT id, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
repeated AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY id),
stats AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(repeated.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (id) LEFT JOIN repeated USING (id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats
"""

QUERIES = {"op2_quality": op2_quality, "quality_statistics": quality_statistics}
ORACLES = {"quality_statistics": STATISTICS}
