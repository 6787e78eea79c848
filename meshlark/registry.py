"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import core, entities, events, geometry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.Q | geometry.Q | entities.Q | events.Q


def oracle_sql() -> dict[str, str]:
    return core.SQL | geometry.SQL | entities.SQL | events.SQL
