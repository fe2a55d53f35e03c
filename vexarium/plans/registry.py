"""Name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexarium.plans.bindings import Domain, oracle

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Domain], DataFrame]], Callable[[Domain], DataFrame]]:
    """Register a function of the domain tables under `name`, with the SQL that gives the same rows (over d_ tables)."""

    def wrap(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = (lambda spark, sf_dir: fn(Domain(spark, sf_dir)), None if sql is None else oracle(sql))
        return fn

    return wrap


def registered() -> dict[str, tuple[Query, str | None]]:
    return dict(_REGISTRY)
