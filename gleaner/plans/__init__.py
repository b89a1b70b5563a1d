"""The engine's queries over the driver tables."""

from gleaner.plans import file_queries, listing_queries, source_queries, table_queries, text_queries
from gleaner.plans.catalog import QUERIES

__all__ = ["QUERIES", "file_queries", "listing_queries", "source_queries", "table_queries", "text_queries"]
