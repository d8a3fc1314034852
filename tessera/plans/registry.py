"""Name -> query and name -> SQL for every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship_package
from tessera.sources import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Which operators of the survey each query exercises.
COVERS: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of one dataset folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)


def query(covers: str, sql: str | None = None):
    """Register a function of Tables under its own name, with its DuckDB counterpart."""

    def add(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(Tables(spark, sf_dir))

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        COVERS[function.__name__] = covers
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add
