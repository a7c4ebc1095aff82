"""All queries of the catalogue."""

from __future__ import annotations

from . import graph_queries, live_queries, readout_queries, source_queries, stats_queries  # noqa: F401
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
