"""All queries over the driver's tables."""

from . import graph, lookups, market, memory, retrieval, search, storage, streams, telemetry, text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
