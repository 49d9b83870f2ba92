"""All queries of the reconciliation engine and their DuckDB SQL."""

from __future__ import annotations

from .plans import documents, folds, oplog, routes, states  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
