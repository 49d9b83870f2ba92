"""Queries by key, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str):
    def register(function):
        QUERIES[key], ORACLES[key] = function, sql
        return function

    return register
