"""Every query of this subpackage and its SQL, by name."""

from __future__ import annotations

from verdict.llm import queries_audit, queries_html, queries_jaccard, queries_lines, queries_media, queries_mixing, queries_passages, queries_quality, queries_runs, queries_toxicity, queries_urls, queries_vectors

_MODULES = [queries_toxicity, queries_urls, queries_vectors, queries_quality, queries_lines, queries_jaccard, queries_media, queries_html, queries_passages, queries_mixing, queries_vectors, queries_runs, queries_audit]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
