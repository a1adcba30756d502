"""Queries and oracle SQL of the datasheet operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dimensions, files, geometry, intake, notation, pages, solving, streams

MODULES = (pages, intake, files, dimensions, geometry, notation, solving, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
