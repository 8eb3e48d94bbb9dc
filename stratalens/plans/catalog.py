"""All queries by name, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.plans import cards, git, graphs, health, ops, texts

PLANS = (git, graphs, health, texts, ops, cards)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in PLANS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PLANS for k, v in p.ORACLE.items()}
