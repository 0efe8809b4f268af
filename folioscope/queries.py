"""All queries of the analytics engine and the SQL each is held against."""

from .plans import log_queries, more_queries, page_queries, rule_queries, store_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
