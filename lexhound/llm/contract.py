"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_bitslice, queries_bpe, queries_html, queries_lang_id, queries_lines, queries_mixing, queries_pii, queries_quality, queries_sharding, queries_simhash

_MODULES = (queries_bitslice, queries_bpe, queries_html, queries_lang_id, queries_lines, queries_mixing, queries_pii, queries_quality, queries_sharding, queries_simhash)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
