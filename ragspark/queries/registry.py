"""Registered queries: a job on the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragspark.session import spread, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale directory, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self._folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files."""
        # A pattern fits a table that is one file as well as one that is a folder.
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self._folder}/{name}.parque[t]")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are about to go through expensive expressions."""
        return spread(getattr(self, name))


def query(name: str, sql: str | None = None):
    """Register a job ``f(tables) -> DataFrame`` under a name."""
    def add(job: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: job(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return job
    return add
