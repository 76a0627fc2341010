"""Every registered query, with the inventory entries it covers and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textlake.plans import restated
from textlake.sources import files


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Tables:
    """``t(name)`` reads a table, ``t.listing()`` the folder that they lie in."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def listing(self) -> DataFrame:
        return files.listing(self.spark, self.sf_dir)


def query(covers: str, sql: str | None = None):
    """Registers ``f(t)``, where ``t`` are the Tables, under the function's name."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = Query(run, covers, sql or restated.SQL.get(f.__name__))
        return f

    return register
