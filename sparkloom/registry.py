"""Registered queries of the engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import catalog_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog_queries.queries()


def oracle_sql() -> dict[str, str]:
    return catalog_queries.oracle_sql()
