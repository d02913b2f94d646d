"""All queries of the panel engine."""

from __future__ import annotations

from . import accounting_queries, factor_queries, incremental_queries, model_queries, named_queries, pool_queries, pure_queries, regime_queries, signal_queries, training_queries, universe_queries, walk_queries  # noqa: F401  they register their queries
from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
