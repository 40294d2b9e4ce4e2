"""Registered queries: a Spark plan over the driver tables and its SQL twin."""

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The parquet tables of one data folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a plan ``Tables -> DataFrame`` under a name."""

    def register(plan: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(Tables(spark, folder))

        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = dedent(sql).strip()
        return plan

    return register
