"""All catalog queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["text_queries", "record_queries", "rule_queries", "matching_queries", "linkage_queries", "insight_queries", "cluster_queries", "tree_queries", "report_queries"]


def entries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for name in MODULES:
        module = import_module(f"plenum.catalog.{name}")
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found |= module.QUERIES
    return found
