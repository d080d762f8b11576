"""The subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["p1", "p2", "p3", "p4", "p5", "p6", "p8", "p9", "p10"]
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"leafmill.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
