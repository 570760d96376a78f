"""Name registries: queries with their SQL oracles, and pluggable strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Case-sensitive names; registering another object under a taken name is an error, the same object is not."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def register(self, name: str):
        key = getattr(name, "value", name)

        def add(f):
            if self.items.setdefault(key, f) is not f:
                raise ValueError(f"{self.kind} {key!r} is registered already")
            return f

        return add

    def get(self, name: str):
        key = getattr(name, "value", name)
        if key not in self.items:
            raise KeyError(f"unknown {self.kind}: {key!r}; known: {sorted(self.items)}")
        return self.items[key]


class Tables:
    """Attribute access to the tables of a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add
