"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import mining, relational, retrieval

Query = Callable[[SparkSession, str], DataFrame]
PLANS = (retrieval, mining, relational)


def queries() -> dict[str, Query]:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.ORACLE.items()}
