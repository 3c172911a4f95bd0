"""Registered queries: a Spark job over the given tables and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from siftlab.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access to the given tables: ``t.orders`` is a Parquet scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """The table on all cores, for work that is heavy per row."""
        return spread(getattr(self, name))


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a job under a name; ``sql`` is the equivalent statement over the same tables."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return register


def _run(build, spark: SparkSession, folder: str) -> DataFrame:
    return build(Tables(spark, folder))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, q.build) for name, q in REGISTRY.items()}


def statements() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
