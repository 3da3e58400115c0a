"""Registered queries of the raster operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.plans import oracles
from pointweave.plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.ALL)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
