"""Losses and metrics as aggregates over columns y (prediction) and t (target); partial sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenark.functions.scalar import log_one_plus_exp


def mse(y: Column, t: Column, w: Column | None = None) -> Column:
    e = (y - t) * (y - t)
    return F.avg(e) if w is None else F.sum(w * e) / F.sum(w)


def mae(y: Column, t: Column, w: Column | None = None) -> Column:
    e = F.abs(y - t)
    return F.avg(e) if w is None else F.sum(w * e) / F.sum(w)


def mape(y: Column, t: Column) -> Column:
    """As a fraction; rows with a zero target are left out."""
    return F.avg(F.abs(F.try_divide(t - y, t)))


def log_cosh(y: Column, t: Column) -> Column:
    return F.avg(F.log(F.cosh(y - t)))


def huber_row(y: Column, t: Column, delta: float = 1.0, epsilon: float = 0.0) -> Column:
    """Nothing within epsilon, squared up to delta + epsilon, then linear."""
    e = F.abs(y - t)
    return F.when(e <= epsilon, 0.0).when(e <= delta + epsilon, (e - epsilon) * (e - epsilon) / 2).otherwise(delta * (e - epsilon) - delta * delta / 2)


def huber(y: Column, t: Column, delta: float = 1.0, epsilon: float = 0.0) -> Column:
    return F.avg(huber_row(y, t, delta, epsilon))


def binary_cross_entropy(p: Column, t: Column, epsilon: float = 1e-8) -> Column:
    return -F.avg(t * F.log(p + epsilon) + (1 - t) * F.log(1 - p + epsilon))


def logits_cross_entropy(y: Column, t: Column) -> Column:
    return F.avg(y * (1 - t) + log_one_plus_exp(-y))


def pearson_loss(y: Column, t: Column, epsilon: float = 1e-8) -> Column:
    return 1 - F.covar_pop(y, t) * F.count(y) / F.sqrt(F.var_pop(y) * F.var_pop(t) * F.count(y) * F.count(y) + epsilon)


def r2(y: Column, t: Column) -> Column:
    return 1 - F.sum((t - y) * (t - y)) / (F.var_pop(t) * F.count(t))
