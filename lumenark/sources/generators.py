"""Made-up training tables. Rows come from spark.range and numbers from the row and a seed, so a table is the same however
it is split, and as long as asked for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.operators.sampling import uniform


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number from the keys and a seed, by two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(~seed, *keys))


def spiral(spark: SparkSession, points: int = 1000, arms: int = 3, noise: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, arm, x0, x1): arms of points whose radius grows from 0 to 1 while they turn by 4, a noise in the angle."""
    r = (F.col("id") % points) / points
    turn = 4.0 * (r + F.col("arm")) + normal(seed, "id") * noise
    arm = spark.range(points * arms).withColumn("arm", (F.col("id") / points).cast("int"))
    return arm.select("id", "arm", (r * F.cos(turn)).alias("x0"), (r * F.sin(turn)).alias("x1"))


def linear(spark: SparkSession, weights: list[float], bias: float, rows: int = 200, noise: float = 0.01, seed: int = 1) -> DataFrame:
    """(id, x0.., y): normal features and their weighted sum, with noise."""
    x = spark.range(rows).select("id", *(normal(seed + 1 + i, "id").alias(f"x{i}") for i in range(len(weights))))
    return x.withColumn("y", sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), F.lit(bias)) + normal(seed, "id") * noise)


def polynomial(spark: SparkSession, weights: list[float], bias: float, rows: int = 200, noise: float = 0.01, seed: int = 1) -> DataFrame:
    """(id, x, x1.., y): the powers 1, 2, ... of a normal number and their weighted sum, with noise."""
    x = spark.range(rows).select("id", normal(seed + 1, "id").alias("x"))
    x = x.select("*", *(F.pow("x", F.lit(i + 1)).alias(f"x{i + 1}") for i in range(len(weights))))
    return x.withColumn("y", sum((F.col(f"x{i + 1}") * w for i, w in enumerate(weights)), F.lit(bias)) + normal(seed, "id") * noise)


def wave(spark: SparkSession, rows: int, noise: float = 0.5, seed: int = 1) -> DataFrame:
    """(id, x, y): x even in [0, 5), y = 2 sin x + x ** 0.8, with noise."""
    x = spark.range(rows).select("id", (uniform(seed + 1, "id") * 5).alias("x"))
    return x.withColumn("y", 2 * F.sin("x") + F.pow("x", F.lit(0.8)) + normal(seed, "id") * noise)


def wave_grid(spark: SparkSession) -> DataFrame:
    """(id, x, y): the curve of `wave` without noise, at every tenth of [0, 5)."""
    x = spark.range(50).select("id", (F.col("id") / 10).alias("x"))
    return x.withColumn("y", 2 * F.sin("x") + F.pow("x", F.lit(0.8)))


def mixture(spark: SparkSession, weights: list[float], means: list[list[float]], covariances: list[list[list[float]]], rows: int, seed: int = 1) -> DataFrame:
    """(id, part, x): draws from a mixture of normals; x is the part's mean plus its Cholesky factor times normal numbers."""
    import numpy as np

    size = len(means[0])
    edges = np.cumsum(weights) / np.sum(weights)
    part = sum(((uniform(seed, "id") >= float(e)).cast("int") for e in edges[:-1]), F.lit(0))
    z = spark.range(rows).select("id", part.alias("part"), F.array(*(normal(seed + 1 + i, "id") for i in range(size))).alias("z"))

    def drawn(k: int) -> Column:
        factor = np.linalg.cholesky(np.array(covariances[k]))
        return F.array(*(sum((F.get("z", F.lit(j)) * float(factor[i, j]) for j in range(i + 1)), F.lit(float(means[k][i]))) for i in range(size)))

    return z.select("id", "part", F.coalesce(*(F.when(F.col("part") == k, drawn(k)) for k in range(len(means)))).alias("x"))
