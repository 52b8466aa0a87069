"""All queries: the modules that register them."""

from __future__ import annotations

from . import corpus_queries, merge_queries, relational_queries, statistics_queries, text_queries, token_queries, vocabulary_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "bytes_per_piece"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
