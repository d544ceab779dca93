"""All graph and retrieval queries, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import admin, answers, corpus, exports, graphs, knowledge, retrieval, rules, stored

#: Plan modules, each with QUERIES (name -> callable) and ORACLE (name -> SQL).
MODULES = (retrieval, graphs, corpus, knowledge, admin, answers, exports, rules, stored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
