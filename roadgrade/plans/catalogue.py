"""Queries over the driver's tables, one for each operator, and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import build, network, rank, show

_PARTS = (build, rank, show, network)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in _PARTS for k, (_, sql) in part.QUERIES.items() if sql}
