"""k-means, k-medians, Gaussian mixtures and principal components over array columns; centres are few and broadcast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import vector as V
from lumenark.operators.sampling import uniform


def assigned(df: DataFrame, centres: DataFrame, distance=V.squared_distance) -> DataFrame:
    """Adds cid and d, the nearest centre (cid, c) and its distance, the least cid of equal ones.

    All centres come as one row holding an array, so that no row is multiplied by them.
    """
    row = centres.agg(F.array_sort(F.collect_list(F.struct("cid", "c"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda s: F.struct(distance(F.col("x"), s["c"]).alias("d"), s["cid"].alias("cid"))))
    return df.join(F.broadcast(row)).withColumn("near", near).select(*df.columns, "near.cid", "near.d")


def means(df: DataFrame) -> DataFrame:
    """(cid, c, n): the mean vector of each cluster; a cluster without members has no row."""
    place = df.select("cid", F.posexplode("x").alias("i", "v")).groupBy("cid", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return place.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))


def medians(df: DataFrame) -> DataFrame:
    """As means, with the median of each place."""
    place = df.select("cid", F.posexplode("x").alias("i", "v")).groupBy("cid", "i").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    return place.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))


def lloyd(df: DataFrame, centres: np.ndarray, rounds: int = 20, median: bool = False) -> tuple[np.ndarray, float]:
    """(centres, error) after so many rounds or once nothing moves. A centre that loses its members stays where it is."""
    spark, distance = df.sparkSession, V.manhattan if median else V.squared_distance

    def nearest() -> DataFrame:
        return assigned(df, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cid int, c array<double>"), distance)

    for _ in range(rounds):
        new = centres.copy()
        for r in (medians(nearest()) if median else means(nearest())).collect():
            new[r.cid] = r.c
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-12:
            break
    return centres, nearest().agg(F.sum("d")).first()[0]


def covariance(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, n) of array column x: every task sums products of its rows, and these are added by place.

    Null vectors are left out; without rows the mean has no places and n is 1.
    """

    def run(batches):
        total = None
        for b in batches:
            x = [v for v in b["x"] if v is not None]
            if x:
                x = np.c_[np.ones(len(x)), np.stack(x).astype(float)]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    sums = {r.i: r.s for r in df.select("x").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    if not sums:
        return np.zeros(0), np.zeros((0, 0)), 1
    side = math.isqrt(len(sums))
    g = np.array([sums[i] for i in range(side * side)]).reshape(side, side)
    m = g[0, 1:] / g[0, 0]
    return m, g[1:, 1:] / g[0, 0] - np.outer(m, m), int(g[0, 0])


def principal(df: DataFrame, share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, std, basis): z-scored principal components, the fewest that hold the share of the variance."""
    m, c, _ = covariance(df)
    s = np.sqrt(np.diag(c))
    s[s == 0] = 1
    values, vectors = np.linalg.eigh(c / np.outer(s, s))
    order = np.argsort(-values)
    kept = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), share)) + 1
    basis = vectors[:, order[:kept]]
    return m, s, basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(kept)])


def elbow(errors: DataFrame) -> DataFrame:
    """(k): one more than the place of the largest second difference of error by k."""
    n = errors.withColumn("k1", F.col("k") + 1).select(F.col("k1").alias("k"), F.col("error").alias("e1"))
    m = errors.select((F.col("k") - 1).alias("k"), F.col("error").alias("e2"))
    return errors.join(n, "k").join(m, "k").select("k", (F.col("e1") - 2 * F.col("error") + F.col("e2")).alias("c")).agg(F.max_by("k", "c").alias("k"))


def projected(x: Column, matrix: np.ndarray) -> Column:
    """The products of a vector with each row of a matrix, which stands in the plan as one constant."""
    rows = F.lit(matrix.astype(float).ravel().tolist()) if matrix.size else F.array().cast("array<double>")
    starts_ = F.sequence(F.lit(0), F.lit(len(matrix) - 1))
    # bound first, so that the vector's own expression is not evaluated again for each row of the matrix
    return V.let(x, lambda v: F.transform(starts_, lambda i: V.dot(F.slice(rows, i * matrix.shape[1] + 1, matrix.shape[1]), v)))


def recovered(df: DataFrame, basis: np.ndarray) -> DataFrame:
    """Adds r, the z-scored vector that the components z (one place for each column of the basis) stand for."""
    return df.withColumn("r", projected(F.col("z"), basis))


def starts(df: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """k rows of the table as first centres, those with the least numbers drawn from key and seed."""
    rows = df.select(key, "x", uniform(seed, key).alias("_u")).orderBy("_u", key).limit(k).collect()
    return np.array([r.x for r in rows], float)


def best_of(df: DataFrame, key: str, k: int, count: int, rounds: int = 20) -> tuple[np.ndarray, float]:
    """(centres, error) of the best of `count` fits from different starts, the first of equal ones."""
    if k < 1 or count < 1:
        raise ValueError("k and count must be one or more")
    return min((lloyd(df, starts(df, key, k, seed), rounds) for seed in range(count)), key=lambda fit: fit[1])


def uniform_reference(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, x): as many rows, every place even between the least and the greatest value it has in df."""
    place = df.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i").collect()
    return df.select(key, F.array(*(uniform(seed * len(place) + r.i, key) * (r.b - r.a) + r.a for r in place)).alias("x"))


def gap_statistic(df: DataFrame, key: str, ks: list[int], errors: list[float], count: int = 5, rounds: int = 10) -> tuple[int, list[float]]:
    """(place of the largest gap, gaps): how far the log error of each k lies below its mean over `count` uniform references."""
    if len(ks) == 1:
        return 0, [0.0]
    references = [uniform_reference(df, key, seed) for seed in range(1, count + 1)]
    gaps = [float(np.mean([np.log(lloyd(r, starts(r, key, k, 0), rounds)[1]) for r in references]) - np.log(e)) for k, e in zip(ks, errors, strict=True)]
    return int(np.argmax(gaps)), gaps


def farthest_choice(choices: list[int]) -> int:
    """What several ways of choosing a place come to: the greatest."""
    return max(choices, default=0)
