"""The registry of queries: a name, a DataFrame over the driver's tables, and the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.model import Model, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Model], DataFrame]], Callable[[Model], DataFrame]]:
    """Registers a function of the model under a name; the SQL may use the model's relations."""

    def add(fn: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_relations(sql)
        return fn

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from tessera.plans import checks, states, store, transactions  # noqa: F401
