"""Statistics and tests: one aggregate each, and the distribution functions of a public library inside Spark's own JVM."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moments(x: Column) -> dict[str, Column]:
    """Population moments from power sums about the mean, in one pass."""
    return {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_pop(x), "skew": F.skewness(x), "kurtosis": F.kurtosis(x)}


def omnibus(n: Column, s: Column, q: Column) -> Column:
    """The normality statistic from sample size, skewness and excess kurtosis."""
    return s * s * (n + 1) * (n + 3) / (6 * (n - 2)) + F.pow(q + 6 / (n + 1), F.lit(2)) * (n + 1) * (n + 1) * (n + 3) * (n + 5) / (24 * n * (n - 2) * (n - 3))


def survival(spark: SparkSession, name: str, x: float, *parameters: float) -> float:
    """P(X > x) of a distribution: TDistribution, FDistribution, ChiSquaredDistribution or NormalDistribution."""
    d = getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, parameters))
    return 1.0 - d.cumulativeProbability(float(x))


def quantile(spark: SparkSession, name: str, p: float, *parameters: float) -> float:
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, parameters)).inverseCumulativeProbability(float(p))


def ljung_box(n: int, r: dict[int, float]) -> float:
    return n * (n + 2) * sum(x * x / (n - k) for k, x in r.items())


def runs_left(n0: int, n1: int, runs: int, spark: SparkSession | None = None) -> float:
    """Left tail of the runs test: exact for up to 30 of each, else by the normal distribution; 0 where one kind is missing."""
    if not n0 or not n1:
        return 0.0
    n = n0 + n1
    if n0 <= 30 and n1 <= 30:
        c = math.comb
        ways = 0
        for r in range(2, runs + 1):
            k = r // 2
            if r % 2 == 0:
                ways += 2 * c(n0 - 1, k - 1) * c(n1 - 1, k - 1)
            else:
                ways += c(n0 - 1, k - 1) * c(n1 - 1, k) + c(n0 - 1, k) * c(n1 - 1, k - 1)
        return ways / c(n, n0)
    mean = 2 * n0 * n1 / n + 1
    sd = math.sqrt(2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1)))
    return 0.5 * math.erfc(-(runs - mean) / sd / math.sqrt(2))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """(by..., entropy, gini) of class counts."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.log2(n)).alias("l"), F.sum(F.col(n) * F.col(n)).alias("q"))
    return total.select(*by, (F.log2("t") - F.col("l") / F.col("t")).alias("entropy"), (1 - F.col("q") / (F.col("t") * F.col("t"))).alias("gini"))


def _at_ranks(df: DataFrame, v: Column, ranks: list[int], brackets: list[tuple[float, float]]) -> dict[int, float]:
    """The values at 0-based ranks that lie in a bracket; without brackets all distinct values are ranked."""
    inside = functools.reduce(operator.or_, (v.between(*b) for b in brackets)) if brackets else F.lit(True)
    segment = sum((F.when(v >= low, 1).otherwise(0) for low, _ in brackets), F.lit(0))
    counts = df.where(v.isNotNull()).groupBy(segment.alias("s"), F.when(inside, v).alias("v")).agg(F.count("*").alias("n"))
    before = counts.select("v", "n", (F.sum("n").over(Window.orderBy("s", F.asc_nulls_last("v"))) - F.col("n")).alias("b"))
    found = before.where(F.col("v").isNotNull() & functools.reduce(operator.or_, ((F.col("b") <= r) & (F.col("b") + F.col("n") > r) for r in ranks)))
    rows = found.collect()
    return {r: x.v for r in ranks for x in rows if x.b <= r < x.b + x.n}


def quantiles(df: DataFrame, value: str, shares: list[float], accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles at the places (n - 1) * share, between two ranks to the bit as DuckDB's quantile_cont; None without values.

    Approximate quantiles bracket the ranks, then only distinct values inside a bracket are ranked, a few rows in 10,000.
    Nulls do not count and NaN is greater than all numbers.
    """
    v = F.col(value).cast("double")
    margin = 3 / accuracy
    n, cuts = df.agg(F.count(v), F.percentile_approx(v, [min(max(s + m, 0.0), 1.0) for s in shares for m in (-margin, margin)], accuracy)).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = _at_ranks(df, v, ranks, list(zip(cuts[::2], cuts[1::2], strict=True)) if n > 10 * accuracy else [])
    if len(at) < len(ranks):
        at = _at_ranks(df, v, ranks, [])
    out = []
    for p in places:
        low, high, part = at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)
        out.append(_mixed(low, high, part) if part else low)
    return out


def _mixed(low: float, high: float, part: float) -> float:
    """low * (1 - part) + high * part with the first product unrounded, which moves limits by a last bit even between equal values."""
    try:
        return math.fma(low, 1 - part, high * part)
    except (OverflowError, ValueError):
        return low * (1 - part) + high * part


def scaled(df: DataFrame, value: str, kind: str, out: str = "z") -> DataFrame:
    """Adds the scaled value: minmax, standard (population), median (median and raw median deviation), robust (quartiles).

    A constant column gives null. The statistics are one row, broadcast.
    """
    v = F.col(value)
    if kind == "minmax":
        s = df.agg(F.min(value).alias("_a"), (F.max(value) - F.min(value)).alias("_b"))
    elif kind == "standard":
        s = df.agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_b"))
    elif kind == "robust":
        s = df.agg(F.percentile(value, F.lit(0.5)).alias("_a"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("_b"))
    elif kind == "median":
        m = df.agg(F.percentile(value, F.lit(0.5)).alias("_a"))
        s = df.join(F.broadcast(m)).groupBy("_a").agg(F.percentile(F.abs(v - F.col("_a")), F.lit(0.5)).alias("_b"))
    else:
        raise ValueError(f"unknown scaler {kind}")
    return df.join(F.broadcast(s)).withColumn(out, F.try_divide(v - F.col("_a"), F.col("_b"))).drop("_a", "_b")
