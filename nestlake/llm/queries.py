"""Queries and SQL of the training-text operators."""

from nestlake.llm import corpus_queries, langid_queries, mojibake_queries, subjects_queries, terms_queries

_MODULES = [mojibake_queries, terms_queries, langid_queries, corpus_queries, subjects_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
