"""Where queries are registered, each beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Tables = Callable[[str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Worked examples over rows of their own, and their results; a query over the tables takes the place of the example of its name.
EXAMPLES: dict[str, Query] = {}
EXAMPLE_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[SparkSession, Tables], DataFrame]], Query]:
    """Registers ``f(spark, table)`` under its own name; without ``sql`` its rows have no SQL twin."""

    def register(f: Callable[[SparkSession, Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, tables(spark, sf_dir))

        run.__name__, run.__doc__ = name or f.__name__, f.__doc__
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register



def example(sql: str | None = None) -> Callable[[Callable[[SparkSession, Tables], DataFrame]], Query]:
    """Registers a worked example, whose SQL is the result worked out by hand."""

    def register(f: Callable[[SparkSession, Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        EXAMPLES[f.__name__] = run
        EXAMPLE_SQL[f.__name__] = sql
        return run

    return register
