"""Where queries are registered: a name, the Spark function, and the same as SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r3(c: Column) -> Column:
    """To millimetres, with the border off the ties that decimal inputs make."""
    return F.floor(c * 1000 + 0.37) / 1000


def r3_sql(c: str) -> str:
    return f"floor(({c}) * 1000 + 0.37) / 1000"
