"""All named queries and their SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from stemma.plans import knowledge, linking, retrieval, site, structure

MODULES: list[ModuleType] = [retrieval, structure, knowledge, linking, site]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Public functions of (spark, sf_dir) in the modules, except the helpers they name in NOT_QUERIES."""
    out = {}
    for m in MODULES:
        for name, f in vars(m).items():
            if inspect.isfunction(f) and f.__module__ == m.__name__ and name[0] != "_" and name not in getattr(m, "NOT_QUERIES", ()) and list(inspect.signature(f).parameters) == ["spark", "sf_dir"]:
                out[name] = f
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
