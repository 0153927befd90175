"""The queries of the core operators by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _core


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_core.SQL)
