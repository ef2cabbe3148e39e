"""Exact quantiles and the filter on them, against DuckDB to the last bit."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.operators import stats
from lumenark.plans import catalog

NAN, INF = float("nan"), float("inf")


def kept(spark, tmp_path, values):
    """Ids that the query and its SQL keep."""
    df = spark.createDataFrame(list(enumerate(values)), "event_id long, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(r[0] for r in con.sql(catalog.oracle_sql()["filter_interquartile"]).fetchall())
    return sorted(r.event_id for r in catalog.queries()["filter_interquartile"](spark, str(tmp_path)).collect()), want


@pytest.mark.parametrize(
    "values",
    [
        [35.0, 36.0, 38.11, 45.0, 45.0, 45.0, 50.11, 55.0, 56.11],  # the upper limit is 56.11, by another order of operations 56.10999999999999
        [1.0] * 17 + [None] * 3,  # 17 of 20 rows are inside
        [1.0] * 16 + [None] * 4,  # 16 are too few, so all rows stay
        [None] * 3,
        [1.0] * 18 + [NAN, INF, -INF],
        [5.0],
    ],
)
def test_interquartile_filter_is_its_sqls(spark, tmp_path, values):
    got, want = kept(spark, tmp_path, values)
    assert got == want


def test_quantiles_are_duckdbs_to_the_bit(spark):
    r = np.random.default_rng(5)
    con = duckdb.connect()
    shares = [0.05, 0.25, 0.5, 0.75]
    for n, accuracy in ((2, 10_000), (39, 10_000), (40, 10_000), (30_000, 1000), (30_002, 100), (30_003, 100)):
        v = np.round(r.exponential(50, n), 2 if n < 100 else int(r.integers(0, 9))).tolist()
        want = con.execute("select " + ", ".join(f"quantile_cont(x, {s})" for s in shares) + " from (select unnest(?::double[]) as x)", [v]).fetchall()[0]
        df = spark.createDataFrame([(x,) for x in [*v, None]], "x double")
        assert stats.quantiles(df, "x", shares, accuracy) == list(want)


def test_only_ranks_in_a_bracket_are_found(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert stats._at_ranks(df, F.col("x"), [10, 500], [(400.0, 600.0)]) == {500: 500.0}
