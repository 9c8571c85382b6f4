"""The llm queries and their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from lodestrand.llm import canonical_queries, lookalike_queries, packing_queries, piece_queries, sentence_queries, split_queries, token_queries, truncation_queries

MODULES = [split_queries, canonical_queries, piece_queries, lookalike_queries, sentence_queries, token_queries, packing_queries, truncation_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
