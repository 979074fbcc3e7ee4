"""Planning of questions, query routes, and the queries by name."""

from . import corpus_queries, relational_queries, route_queries, scalar_queries, search_queries, statute_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus_queries", "relational_queries", "route_queries", "scalar_queries", "search_queries", "statute_queries"]
