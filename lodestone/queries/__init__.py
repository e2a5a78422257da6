"""The registered queries of the engine's own operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ALL: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function of the session and a table reader under its name."""

    def add(f: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        ALL[f.__name__] = Query(lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")), sql)
        return f

    return add


def load() -> dict[str, Query]:
    from lodestone.queries import files, groups, symbols  # noqa: F401  they register themselves

    return ALL
