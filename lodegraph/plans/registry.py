"""All queries of the core, by name."""

from __future__ import annotations

from lodegraph.plans import ask_queries, build_queries, domain_queries, eval_queries, graph_queries, quality, report_queries, stream_queries

FLAGSHIP = "neighbourhood_summary"
_PARTS = (quality, graph_queries, domain_queries, build_queries, report_queries, stream_queries, ask_queries, eval_queries)

QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
