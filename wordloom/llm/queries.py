"""Registered queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("q1_lookalikes", "q34_sampling", "q5_cooccurrence", "q6_quantiles", "q7_encode", "q8_packing", "q9_cutoffs")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"wordloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= getattr(_m, "SQL", {})
