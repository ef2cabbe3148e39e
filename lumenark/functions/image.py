"""Two-dimensional patches, convolution and pooling in long form (key, y, x, v); patches come from an expansion of each cell
into the windows it falls in, so no row meets another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, y, x, v) of arrays that hold rows of `width`."""
    p = df.select(key, F.posexplode(column).alias("p", "v"))
    return p.select(key, F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).alias("x"), "v")


def patches(cells: DataFrame, key: str, height: int, width: int, kh: int, kw: int, stride: int = 1, dilation: int = 1) -> DataFrame:
    """(key, oy, ox, ky, kx, v): every cell in every window it belongs to."""
    oh, ow = (height - dilation * (kh - 1) - 1) // stride + 1, (width - dilation * (kw - 1) - 1) // stride + 1
    taps = F.array(*(F.struct(F.lit(i).alias("ky"), F.lit(j).alias("kx")) for i in range(kh) for j in range(kw)))
    placed = cells.select(key, "y", "x", "v", F.inline(taps)).withColumns({"sy": F.col("y") - F.col("ky") * dilation, "sx": F.col("x") - F.col("kx") * dilation})
    inside = (F.col("sy") >= 0) & (F.col("sx") >= 0) & (F.col("sy") % stride == 0) & (F.col("sx") % stride == 0) & (F.col("sy") < oh * stride) & (F.col("sx") < ow * stride)
    return placed.where(inside).select(key, (F.col("sy") / stride).cast("int").alias("oy"), (F.col("sx") / stride).cast("int").alias("ox"), "ky", "kx", "v")


def convolved(patch: DataFrame, key: str, kernel: list[list[float]]) -> DataFrame:
    weight: Column = F.lit(0.0)
    for i, row in enumerate(kernel):
        for j, w in enumerate(row):
            weight = F.when((F.col("ky") == i) & (F.col("kx") == j), w).otherwise(weight)
    return patch.groupBy(key, "oy", "ox").agg(F.sum(F.col("v") * weight).alias("v"))
