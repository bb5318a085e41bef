"""Named queries over the test tables and the SQL that they are checked against."""

from . import count_queries, evidence_queries, prompt_queries, search_queries, source_queries, stream_queries, text_queries

_ALL = (text_queries, source_queries, search_queries, count_queries, evidence_queries, prompt_queries, stream_queries)
QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLES = {name: q for m in _ALL for name, q in m.ORACLES.items()}
