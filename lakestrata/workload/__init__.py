"""Named queries over the standard tables, each with the SQL that states its answer."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    name: str
    covers: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Lazy access to the Parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``covers`` lists survey ids."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every workload module and return the registry."""
    from importlib import import_module
    from pkgutil import iter_modules

    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
    return REGISTRY
