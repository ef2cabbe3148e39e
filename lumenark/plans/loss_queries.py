"""Losses and metrics. Regression pairs are lineitem's price against a linear guess, binary pairs events' clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import losses as L
from lumenark.functions import scalar as S
from lumenark.plans.kit import Query, rounded, totals


def _pairs(df: DataFrame) -> DataFrame:
    return df.select((F.col("l_quantity") * 1500.0 / 10000).alias("y"), (F.col("l_extendedprice") / 10000).alias("t"), (F.col("l_tax") + 0.01).alias("w"), F.col("l_returnflag").alias("g"))


_P = "(SELECT l_quantity * 1500.0 / 10000 AS y, l_extendedprice / 10000 AS t, l_tax + 0.01 AS w, l_returnflag AS g FROM lineitem)"



def _y():
    return F.col("y"), F.col("t")


_PAIRS: dict[str, tuple] = {
    "loss_mse": (lambda: L.mse(*_y()), "avg((y - t) * (y - t))"),
    "loss_mse_weighted": (lambda: L.mse(*_y(), F.col("w")), "sum(w * (y - t) * (y - t)) / sum(w)"),
    "loss_half_mse": (lambda: L.mse(*_y()) / 2, "avg((y - t) * (y - t)) / 2"),
    "loss_mae": (lambda: L.mae(*_y()), "avg(abs(y - t))"),
    "loss_mae_weighted": (lambda: L.mae(*_y(), F.col("w")), "sum(w * abs(y - t)) / sum(w)"),
    "loss_mape": (lambda: L.mape(*_y()), "avg(abs((t - y) / nullif(t, 0)))"),
    "metric_mape_percent": (lambda: L.mape(*_y()) * 100, "100 * avg(abs((t - y) / nullif(t, 0)))"),
    "loss_log_cosh": (lambda: L.log_cosh(*_y()), "avg(ln((exp(y - t) + exp(t - y)) / 2))"),
    "loss_huber": (lambda: L.huber(*_y()), "avg(CASE WHEN abs(y - t) <= 0 THEN 0 WHEN abs(y - t) <= 1 THEN (y - t) * (y - t) / 2 ELSE abs(y - t) - 0.5 END)"),
    "loss_huber_insensitive": (lambda: L.huber(*_y(), 0.5, 0.2), "avg(CASE WHEN abs(y - t) <= 0.2 THEN 0 WHEN abs(y - t) <= 0.7 THEN (abs(y - t) - 0.2) * (abs(y - t) - 0.2) / 2 ELSE 0.5 * (abs(y - t) - 0.2) - 0.125 END)"),
    "loss_pearson": (lambda: L.pearson_loss(*_y()), "1 - covar_pop(y, t) * count(*) / sqrt(var_pop(y) * var_pop(t) * count(*) * count(*) + 1e-8)"),
    "metric_rmse": (lambda: F.sqrt(L.mse(*_y())), "sqrt(avg((y - t) * (y - t)))"),
    "metric_log_mse": (lambda: F.avg(F.pow(F.log(F.greatest(F.col("y"), F.lit(0.1))) - F.log(F.col("t")), F.lit(2))), "avg(pow(ln(greatest(y, 0.1)) - ln(t), 2))"),
    "metric_log_rmse": (lambda: F.sqrt(F.avg(F.pow(F.log(F.greatest(F.col("y"), F.lit(0.1))) - F.log(F.col("t")), F.lit(2)))), "sqrt(avg(pow(ln(greatest(y, 0.1)) - ln(t), 2)))"),
    "metric_sum_absolute": (lambda: F.sum(F.abs(F.col("y") - F.col("t"))), "sum(abs(y - t))"),
    "metric_sum_squares": (lambda: F.sum((F.col("y") - F.col("t")) * (F.col("y") - F.col("t"))), "sum((y - t) * (y - t))"),
    "metric_r2": (lambda: L.r2(*_y()), "1 - sum((t - y) * (t - y)) / (var_pop(t) * count(*))"),
    "metric_perplexity": (lambda: F.exp(L.mae(*_y())), "exp(avg(abs(y - t)))"),
}
QUERIES: dict[str, Query] = {n: totals("lineitem", lambda f=f: {"value": rounded(f(), 4)}, ["g"], _pairs) for n, (f, _) in _PAIRS.items()}
SQL: dict[str, str] = {n: f"SELECT g, round({s}, 4) + 0.0::DOUBLE AS value FROM {_P} GROUP BY g" for n, (_, s) in _PAIRS.items()}


def _binary(df: DataFrame) -> DataFrame:
    x = F.col("value") / 50 - 1
    return df.select(x.alias("x"), S.sigmoid(x).alias("p"), (F.col("event_type") == "click").cast("double").alias("t"), "event_type")


_BIN = "(SELECT value / 50 - 1 AS x, 1 / (1 + exp(-(value / 50 - 1))) AS p, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM events)"
_BINARY: dict[str, tuple] = {
    "loss_binary_cross_entropy": (lambda: L.binary_cross_entropy(F.col("p"), F.col("t")), "-avg(t * ln(p + 1e-8) + (1 - t) * ln(1 - p + 1e-8))"),
    "loss_logits_cross_entropy": (lambda: L.logits_cross_entropy(F.col("x"), F.col("t")), "avg(x * (1 - t) + ln(1 + exp(-x)))"),
    "metric_binary_accuracy": (lambda: F.avg(((F.col("p") >= 0.5) == (F.col("t") == 1)).cast("double")), "avg(CASE WHEN (p >= 0.5) = (t = 1) THEN 1.0 ELSE 0.0 END)"),
    "logit_loss": (lambda: F.sum(S.log_one_plus_exp(F.col("x")) - F.col("t") * F.col("x")) + 1.0, "sum(ln(1 + exp(x)) - t * x) + 1.0"),
    "logit_gradient": (lambda: F.sum((F.col("p") - F.col("t")) * F.col("x")) + 1.0, "sum((p - t) * x) + 1.0"),
    "logit_hessian": (lambda: F.sum(F.col("p") * (1 - F.col("p")) * F.col("x") * F.col("x")), "sum(p * (1 - p) * x * x)"),
}
QUERIES |= {n: totals("events", lambda f=f: {"value": rounded(f(), 5)}, None, _binary) for n, (f, _) in _BINARY.items()}
SQL |= {n: f"SELECT round({s}, 5) + 0.0::DOUBLE AS value FROM {_BIN}" for n, (_, s) in _BINARY.items()}


def confusion(spark, sf_dir):
    """Counts and scores of a 0/1 prediction, in one pass."""
    d = _binary(spark.read.parquet(f"{sf_dir}/events.parquet")).select((F.col("p") >= 0.5).alias("p"), (F.col("t") == 1).alias("t"))
    c = d.agg(*(F.sum((a & b).cast("long")).alias(n) for n, a, b in (("tp", F.col("p"), F.col("t")), ("fp", F.col("p"), ~F.col("t")), ("fn", ~F.col("p"), F.col("t")), ("tn", ~F.col("p"), ~F.col("t")))))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", rounded((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"))


QUERIES["metric_confusion"] = confusion
SQL["metric_confusion"] = f"""WITH c AS (SELECT count(*) FILTER (p >= 0.5 AND t = 1) AS tp, count(*) FILTER (p >= 0.5 AND t = 0) AS fp, count(*) FILTER (p < 0.5 AND t = 1) AS fn, count(*) FILTER (p < 0.5 AND t = 0) AS tn FROM {_BIN})
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
