"""Registry of queries (spark, sf_dir) -> DataFrame and their DuckDB oracles.

Query names are the operator IDs.  Doubles are rounded to 6 decimals on both
sides (``round_doubles`` / ``rounded``) so the order-insensitive value hash
compares statistics, not the last bits of a summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transcripta.functions.columns import round_doubles
from transcripta.plans.fixture_sql import rounded, with_fixtures
from transcripta.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, fixtures: tuple = (), doubles: tuple = (),
             extra: list | None = None, round_result: bool = True):
    """Register a query; ``sql`` (if any) is wrapped with the fixture CTEs
    and rounded on the listed double columns."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # the workers import this package
            df = fn(spark, sf_dir)
            return round_doubles(df, 6) if round_result else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded(with_fixtures(sql, *fixtures, extra=extra), list(doubles))
        return fn

    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from transcripta.plans import (  # noqa: F401
        q_de, q_sources, q_reshape, q_joins, q_multivariate, q_network,
        q_enrichment, q_immune,
    )
