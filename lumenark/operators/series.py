"""Series: order, lags and runs. Global order statistics go by window over a key where there is one; over a whole table the
values are ranked with a range exchange and per-range offsets, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_row_number(df: DataFrame, order: list[str], name: str = "rn", parts: int = 64) -> DataFrame:
    """Adds the 1-based rank of each row in a total order, without a single task that sorts all rows.

    Ranges of the first order column are cut at approximate quantiles; rows are numbered inside a range and shifted by the
    rows of the ranges before. Equal values of the first column stay in one range, so ties follow the other columns.
    """
    first = order[0]
    cuts = df.agg(F.percentile_approx(F.col(first), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    part = sum((F.when(F.col(first) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    marked = df.withColumn("_part", part)
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return marked.withColumn("_inner", inner).join(F.broadcast(before), "_part").withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")


def lagged(df: DataFrame, value: str, k: int, order: str = "rn", by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Adds the value k rows earlier: by window inside keys, else by an equi-join on the row number."""
    name = name or f"{value}_lag{k}"
    if by:
        return df.withColumn(name, F.lag(value, k).over(Window.partitionBy(*by).orderBy(order)))
    return df.join(df.select((F.col(order) + k).alias(order), F.col(value).alias(name)), order, "left")


def autocovariance(df: DataFrame, value: str, lags: int) -> DataFrame:
    """(k, r): sums of (x_t - mean)(x_{t+k} - mean) over the sum of squares, for k = 1..lags, of a table with row numbers rn.

    Every row meets its successors through one equi-join on the place they share.
    """
    stats = df.agg(F.avg(value).alias("m"))
    c = df.join(F.broadcast(stats)).select("rn", (F.col(value) - F.col("m")).alias("c"))
    ahead = c.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("k"), "rn", "c").select("k", (F.col("rn") + F.col("k")).alias("rn"), F.col("c").alias("a"))
    return ahead.join(c, "rn").groupBy("k").agg(F.sum(F.col("a") * F.col("c")).alias("s")).join(F.broadcast(c.agg(F.sum(F.col("c") * F.col("c")).alias("q")))).select("k", F.try_divide("s", "q").alias("r"))


def runs(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by..., start, end, length): maximal runs of rows for which flag holds, by gaps and islands; places count from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.select(*by, F.row_number().over(w).alias("p"), flag.alias("f"))
    island = placed.where("f").withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(*by).orderBy("p")))
    return island.groupBy(*by, "g").agg((F.min("p") - 1).alias("start"), (F.max("p") - 1).alias("end"), F.count("*").alias("length")).drop("g")


def longest_run(segments: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of each key, the first of equal ones."""
    return segments.groupBy(*by).agg(F.max_by(F.struct("start", "end", "length"), F.struct("length", (-F.col("start")).alias("s"))).alias("b")).select(*by, "b.*")


def windows(df: DataFrame, by: list[str], order: list[str], value: str, back: int, ahead: int) -> DataFrame:
    """(by..., p, x, y): for each place the `back` values from it on and the `ahead` values after these, where there are so many."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.collect_list(value).over(w.rowsBetween(0, back - 1))
    y = F.collect_list(value).over(w.rowsBetween(back, back + ahead - 1))
    return df.select(*by, (F.row_number().over(w) - 1).alias("p"), x.alias("x"), y.alias("y")).where((F.size("x") == back) & (F.size("y") == ahead))
