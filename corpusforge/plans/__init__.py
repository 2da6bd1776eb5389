"""Registered queries of the library."""

from corpusforge.plans import analytics, catalog_queries, operator_queries, relational, stream_queries, text_queries  # noqa: F401
from corpusforge.plans.registry import ORACLE, QUERIES  # noqa: F401
