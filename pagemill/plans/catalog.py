"""A registry of named queries: a Spark function over the driver's tables, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pages import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(key: str, values: list[str]) -> Column:
    """One of the values for each row, by its key."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(key: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(map(sql_text, values))}], CAST({key} % {len(values)} AS BIGINT) + 1)"
