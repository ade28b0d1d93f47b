"""All queries over the input tables, and their equivalents in SQL."""

from quarryline.plans import corpus_queries, relational_queries, report_queries, text_queries  # noqa: F401  they register their queries
from quarryline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
