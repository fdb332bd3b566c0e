"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import bar_queries, contract_queries, port_queries, research_queries, tick_queries

FLAGSHIP = "digit_uniformity"
GROUPS = [tick_queries, contract_queries, bar_queries, research_queries, port_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.ORACLE.items()}
