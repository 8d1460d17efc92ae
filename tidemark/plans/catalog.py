"""All registered queries, in build order (importing a module registers its queries)."""

from tidemark.plans import (event_queries, feature_queries, io_queries, lookup_queries, ml_queries,  # noqa: F401
                            model_queries)
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
