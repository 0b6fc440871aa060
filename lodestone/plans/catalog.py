"""All queries of the library outside the training-data operators."""

from lodestone.plans import knowledge, retrieval, streams  # noqa: F401  (they register their queries)
from lodestone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
