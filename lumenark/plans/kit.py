"""Small helpers for the modules that register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero, so that engines agree on the value."""
    return F.round(c, digits) + F.lit(0.0)


def rows(name: str, keys: list[str], value: Callable[[], Column], alias: str = "y", source: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    """A projection of a whole table: its keys and one computed value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        df = source(df) if source else df
        return df.select(*keys, rounded(value(), 9).alias(alias))

    return query


def totals(name: str, values: Callable[[], dict[str, Column]], by: list[str] | None = None, source: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    """Aggregates over a whole table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        df = source(df) if source else df
        return df.groupBy(*(by or [])).agg(*(c.alias(n) for n, c in values().items()))

    return query
