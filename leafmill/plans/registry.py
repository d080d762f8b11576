"""The core's queries and their SQL, gathered from the operator modules."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

MODULES = ["ledger", "report", "text", "ocr", "pages", "tables", "geometry", "pixels", "state", "quality", "spelling", "correction", "files"]
ROOT = Path(__file__).resolve().parents[2]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        got = getattr(import_module(f"leafmill.operators.{name}"), what)
        if twice := out.keys() & got.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= got
    return out


def queries() -> dict[str, Callable]:
    """Callables (spark, sf_dir) by name."""
    return _gather("QUERIES")


def sql() -> dict[str, str]:
    """SQL by name."""
    return _gather("SQL")


def shipped(query: Callable) -> Callable:
    """``query`` with the package's folder on the path of the Python workers.

    On a cluster whose executors do not see that folder the package has to be installed there, as any library.
    """

    @functools.wraps(query)
    def run(spark, sf_dir):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(ROOT) not in paths:
            env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
        return query(spark, sf_dir)

    return run
