"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from orrery.llm import ann, bpe, decontaminate, html, langid, minhash, quality, recompress, toxicity, url_filter

MODULES = (quality, langid, bpe, decontaminate, recompress, minhash, html, ann, toxicity, url_filter)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
