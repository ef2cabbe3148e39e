"""Functions of array<double> columns, by higher-order functions; an empty array gives null where there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def manhattan(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def minkowski(x: Column, y: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))), F.lit(1 / p))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def jaccard(x: Column, y: Column) -> Column:
    """Of two sets given as arrays."""
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def softmax(x: Column) -> Column:
    return let(F.struct(x.alias("v"), F.array_max(x).alias("m")), lambda r: let(F.transform(r["v"], lambda a: F.exp(a - r["m"])), lambda e: let(total(e), lambda s: F.transform(e, lambda a: a / s))))


def log_softmax(x: Column) -> Column:
    return let(F.struct(x.alias("v"), F.array_max(x).alias("m")), lambda s: let(F.log(total(F.transform(s["v"], lambda a: F.exp(a - s["m"])))), lambda z: F.transform(s["v"], lambda a: a - s["m"] - z)))


def softmax_gradient(y: Column, dy: Column) -> Column:
    """Given the softmax y and the gradient of its output."""
    return let(dot(y, dy), lambda s: F.zip_with(y, dy, lambda a, b: a * (b - s)))


def layer_norm(x: Column, epsilon: float = 1e-8) -> Column:
    n = F.size(x)
    return let(F.struct(x.alias("v"), (total(x) / n).alias("m")), lambda s: let(total(F.transform(s["v"], lambda a: (a - s["m"]) * (a - s["m"]))) / F.size(s["v"]), lambda var: F.transform(s["v"], lambda a: (a - s["m"]) / F.sqrt(var + epsilon))))


def windows(x: Column, size: int, stride: int, f) -> Column:
    """f of each whole window."""
    return F.transform(F.sequence(F.lit(1), F.size(x) - size + 1, F.lit(stride)), lambda i: f(F.slice(x, i, F.lit(size))))


def max_pool(x: Column, size: int, stride: int | None = None) -> Column:
    return windows(x, size, stride or size, F.array_max)


def avg_pool(x: Column, size: int, stride: int | None = None) -> Column:
    return windows(x, size, stride or size, lambda w: total(w) / size)


def conv1d(x: Column, kernel: list[float], stride: int = 1, dilation: int = 1) -> Column:
    """Cross-correlation without padding."""
    span = dilation * (len(kernel) - 1) + 1
    return let(x, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - span, F.lit(stride)), lambda i: sum((F.get(v, i + j * dilation) * k for j, k in enumerate(kernel)), F.lit(0.0))))


def causal_conv(x: Column, kernel: list[float], dilation: int = 1) -> Column:
    """Padded with zeros on the left, so that a place depends on earlier ones only; the last weight meets the place itself."""
    pad = dilation * (len(kernel) - 1)
    return conv1d(F.concat(F.array_repeat(F.lit(0.0), pad), x), kernel, 1, dilation)


def one_hot(i: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == i).cast("double"))


def label_smoothing(i: Column, size: int, alpha: float = 0.1) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == i, 1 - alpha).otherwise(alpha / (size - 1)))


def positional_encoding(pos: Column, i: Column, size: int) -> Column:
    """Sine at even, cosine at odd places i of a vector of `size`."""
    angle = pos / F.pow(F.lit(10000.0), (2 * F.floor(i / 2)) / size)
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def dot_attention(q: Column, k: Column, v: Column, width: int) -> Column:
    """softmax(q k' / sqrt(width)) v for arrays of rows."""
    scale = width**0.5
    return F.transform(q, lambda a: let(softmax(F.transform(k, lambda b: dot(a, b) / scale)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: total(F.zip_with(w, v, lambda p, r: p * F.get(r, j))))))


def rows_of(x: Column, width: int) -> Column:
    """An array cut into rows of `width`."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1), lambda i: F.slice(x, i * width + 1, F.lit(width)))
