"""Samples and splits that depend on keys and a seed only, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the keys and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def hold_out(df: DataFrame, share: float, label: str, key: str, seed: int = 1) -> DataFrame:
    """Adds `train`: of each class ceil(share * n) rows, those of the least hashes.

    The rank in a class comes from ranges of the hash, so no task sorts a whole class.
    """
    u = df.withColumns({"_u": uniform(seed, key), "_cell": F.floor(uniform(seed, key) * 256)})
    cells = u.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    before = cells.withColumns({"_before": F.sum("_n").over(w.orderBy("_cell")) - F.col("_n"), "_all": F.sum("_n").over(w)}).drop("_n")
    inner = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_u", key))
    return u.withColumn("_r", inner).join(F.broadcast(before), [label, "_cell"]).withColumn("train", F.col("_r") + F.col("_before") <= F.ceil(F.col("_all") * share)).drop("_u", "_cell", "_r", "_before", "_all")


def bootstrap(df: DataFrame, key: str, seed: int = 1, most: int = 12) -> DataFrame:
    """Rows with replacement: each row as often as a Poisson(1) draw from its key says."""
    total, p, draws = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(most):
        total += p
        p /= k + 1
        draws = draws + F.when(uniform(seed, key) >= total, 1).otherwise(0)
    return df.withColumn("_k", draws).where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def folds(key: str, k: int, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def roulette(df: DataFrame, weight: str, key: str, seed: int = 1) -> DataFrame:
    """Adds a rank key: the row with the largest value is one drawn in proportion to its weight, the next the second, and so on."""
    return df.withColumn("priority", F.when(F.col(weight) > 0, F.log(uniform(seed, key) + 1e-300) / F.col(weight)))


def duplicates(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds `repeats`, how many rows have the same features; counted before it is joined back, so hot values are split."""
    return df.join(df.groupBy(*features).agg(F.count("*").alias("repeats")), features)
