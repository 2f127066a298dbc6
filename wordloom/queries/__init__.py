"""Registered queries: each module has QUERIES (name -> callable) and SQL (name -> the same in DuckDB's SQL)."""

from __future__ import annotations

import importlib

MODULES = ("raw", "text", "joins", "aggs", "counters", "models", "segmentation", "evals", "predicting", "flows", "states")


def registries():
    """(QUERIES, SQL) of each module."""
    for name in MODULES:
        m = importlib.import_module(f"{__name__}.{name}")
        yield m.QUERIES, m.SQL
