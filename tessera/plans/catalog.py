"""All queries of the library but those of the training-data subpackage."""

from . import interval_queries, maintenance_queries, search_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
