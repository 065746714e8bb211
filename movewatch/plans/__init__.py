"""Named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from movewatch.plans import market, records, signals, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from movewatch.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from movewatch.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
