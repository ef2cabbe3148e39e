"""All queries of the library, by name, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES (name to function) and SQL (name to text).
MODULES: tuple[str, ...] = ("scalar_queries", "loss_queries", "vector_queries", "series_queries", "text_queries", "model_queries", "learn_queries", "extra_queries", "more_queries", "fit_queries", "layer_queries", "recurrent_queries")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"lumenark.plans.{name}"), what)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_moments"](spark, sf_dir)
