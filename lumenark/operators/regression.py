"""Least squares, logistic and Weibull fits. Data is read by aggregates only; a solve sees p by p numbers, never rows."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.operators import stats


@dataclass
class Gram:
    """Sums of products of 1, the features and the target; all that least squares needs."""

    names: list[str]
    m: np.ndarray

    @property
    def n(self) -> float:
        return float(self.m[0, 0])


def grams(df: DataFrame, features: dict[str, Column], target: Column, weight: Column | None = None, by: str | None = None) -> dict:
    """Gram tables by group (one group None without `by`), from one aggregate with partial sums."""
    columns = [F.lit(1.0), *(c.cast("double") for c in features.values()), target.cast("double")]
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs]
    known = df.where(F.coalesce(sum(columns, F.lit(0.0)), F.lit(float("nan"))).isNotNull())
    out = {}
    for r in (known.groupBy(by).agg(*sums) if by else known.agg(*sums)).collect():
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r[by] if by else None] = Gram(list(features), m)
    return out


@dataclass
class LinearFit:
    """Coefficients (intercept first) and inference of a least-squares fit."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: float
    rss: float
    tss: float
    p_values: np.ndarray = field(default_factory=lambda: np.empty(0))
    f_p_value: float = float("nan")

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def sigma2(self) -> float:
        return self.rss / (self.n - self.p)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else 0.0

    @property
    def adjusted_r2(self) -> float:
        return 1 - self.sigma2 / (self.tss / (self.n - 1))

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(self.sigma2 * np.diag(self.covariance))

    @property
    def t(self) -> np.ndarray:
        return self.beta / self.std

    @property
    def f(self) -> float:
        return (self.tss - self.rss) / (self.p - 1) / self.sigma2

    @property
    def cp(self) -> float:
        return (self.rss + 2 * (self.p - 1) * self.sigma2) / self.n

    def _criterion(self, each: float) -> float:
        return each * (self.p - 1) + self.n - self.p + self.n * math.log(2 * math.pi * self.sigma2) if self.sigma2 > 0 else -math.inf

    @property
    def aic(self) -> float:
        return self._criterion(2.0)

    @property
    def bic(self) -> float:
        return self._criterion(math.log(self.n))

    def predict(self, features: dict[str, Column]) -> Column:
        return sum((float(b) * features[k] for k, b in zip(self.names, self.beta[1:], strict=True)), F.lit(float(self.beta[0])))

    def half_width(self, features: dict[str, Column], t_quantile: float, prediction: bool = True) -> Column:
        """Of the interval about a prediction: t * sigma * sqrt([1 +] x C x')."""
        x = [F.lit(1.0), *(features[k] for k in self.names)]
        quadratic = sum((float(self.covariance[i, j]) * x[i] * x[j] for i in range(self.p) for j in range(self.p)), F.lit(1.0 if prediction else 0.0))
        return t_quantile * math.sqrt(self.sigma2) * F.sqrt(quadratic)


def solve(g: Gram, use: list[int] | None = None) -> LinearFit:
    """The fit on some of the features; a singular system takes the least-norm solution."""
    use = list(range(len(g.names))) if use is None else use
    at = [0, *(1 + i for i in use)]
    xx, xy, yy = g.m[np.ix_(at, at)], g.m[at, -1], g.m[-1, -1]
    scale = 1 / np.sqrt(np.maximum(np.diag(xx), 1e-300))
    s = xx * np.outer(scale, scale)
    inverse = (np.linalg.inv(s) if np.linalg.cond(s) < 1e12 else np.linalg.pinv(s, rcond=1e-10)) * np.outer(scale, scale)
    beta = inverse @ xy
    rss = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 0.0)
    return LinearFit([g.names[i] for i in use], beta, inverse, g.n, rss, float(yy - g.m[0, -1] ** 2 / g.n))


def fit_linear(df: DataFrame, features: dict[str, Column], target: Column, weight: Column | None = None) -> LinearFit:
    """Least squares with t and F tests. Rows with a null anywhere are left out."""
    fit = solve(grams(df, features, target, weight)[None])
    spark, dof = df.sparkSession, fit.n - fit.p
    fit.p_values = np.array([2 * stats.survival(spark, "TDistribution", abs(t), dof) for t in fit.t])
    fit.f_p_value = stats.survival(spark, "FDistribution", fit.f, fit.p - 1, dof) if fit.p > 1 else float("nan")
    return fit


def best_subsets(g: Gram, most: int | None = None) -> list[LinearFit]:
    """For each size the features with least squares error; all subsets of one Gram table."""
    every = range(len(g.names))
    return [min((solve(g, list(s)) for s in itertools.combinations(every, k)), key=lambda f: f.rss) for k in range(1, (most or len(g.names)) + 1)]


def forward(g: Gram) -> list[LinearFit]:
    use, out = [], []
    while len(use) < len(g.names):
        best = min((i for i in range(len(g.names)) if i not in use), key=lambda i: solve(g, [*use, i]).rss)
        use = [*use, best]
        out.append(solve(g, use))
    return out


def backward(g: Gram) -> list[LinearFit]:
    use = list(range(len(g.names)))
    out = [solve(g, use)]
    while len(use) > 1:
        use = min(([j for j in use if j != i] for i in use), key=lambda u: solve(g, u).rss)
        out.append(solve(g, use))
    return out


def cross_validated(by_fold: dict, most: int | None = None) -> tuple[int, list[float]]:
    """The best number of features by the mean squared error of left-out folds; from one Gram table for each fold."""
    names = next(iter(by_fold.values())).names
    whole = sum(g.m for g in by_fold.values())
    errors = []
    for k in range(most or len(names)):
        each = []
        for g in by_fold.values():
            fit = best_subsets(Gram(names, whole - g.m), k + 1)[k]
            at = [0, *(1 + names.index(x) for x in fit.names)]
            xx, xy = g.m[np.ix_(at, at)], g.m[at, -1]
            each.append((g.m[-1, -1] - 2 * fit.beta @ xy + fit.beta @ xx @ fit.beta) / g.n)
        errors.append(float(np.mean(each)))
    return int(np.argmin(errors)) + 1, errors


def inflation(g: Gram) -> np.ndarray:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    m = g.m[1:-1, 1:-1] / g.n - np.outer(g.m[0, 1:-1], g.m[0, 1:-1]) / g.n**2
    d = 1 / np.sqrt(np.diag(m))
    return np.diag(np.linalg.inv(m * np.outer(d, d)))


def natural_cubic(x: Column, knots: list[float]) -> list[Column]:
    """The basis of a natural cubic spline: x and one column for each inner knot but one."""

    def cube(k: float) -> Column:
        return F.when(x > k, F.pow(x - k, F.lit(3))).otherwise(F.lit(0.0))

    def d(k: float) -> Column:
        return (cube(k) - cube(knots[-1])) / (knots[-1] - k)

    return [x, *((knots[-1] - k) * (d(k) - d(knots[-2])) for k in knots[:-2])]


def fit_logistic(df: DataFrame, features: dict[str, Column], target: Column, ridge: float = 1.0, rounds: int = 25, epsilon: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(theta, standard errors) of a ridge-penalised logit, intercept first and penalised too; Newton, one aggregate a step."""
    x = [F.lit(1.0), *features.values()]
    p = len(x)
    theta = np.zeros(p)
    hessian = np.eye(p)
    for _ in range(rounds):
        z = sum((float(t) * c for t, c in zip(theta, x, strict=True)), F.lit(0.0))
        s = 1 / (1 + F.exp(-z))
        r = df.agg(*(F.sum((s - target) * c).alias(f"g{i}") for i, c in enumerate(x)), *(F.sum(s * (1 - s) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p))).first()
        gradient = np.array([r[f"g{i}"] for i in range(p)]) + ridge * theta
        hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step = np.linalg.solve(hessian + ridge * np.eye(p), gradient)
        theta = theta - step
        if np.abs(step).max() < epsilon:
            break
    return theta, np.sqrt(np.diag(np.linalg.inv(hessian)))


def fit_weibull(df: DataFrame, value: str, rounds: int = 60) -> tuple[float, float]:
    """(shape, scale) by maximum likelihood: Newton on the shape's profile equation, three sums a step."""
    x = F.col(value).cast("double")
    positive = df.where(x > 0)
    top = positive.agg(F.max(x)).first()[0] or 1.0
    b = 1.0
    for _ in range(rounds):
        u = F.pow(x / top, F.lit(b))
        n, l, s, sl, sll = positive.agg(F.count("*"), F.sum(F.log(x)), F.sum(u), F.sum(u * F.log(x)), F.sum(u * F.log(x) * F.log(x))).first()
        f, d = sl / s - 1 / b - l / n, (sll * s - sl * sl) / (s * s) + 1 / (b * b)
        new = max(b - f / d, b / 3)
        if abs(new - b) < 1e-10 * b:
            break
        b = new
    return b, top * (positive.agg(F.avg(F.pow(x / top, F.lit(b)))).first()[0]) ** (1 / b)


def cubic_spline(x: np.ndarray, y: np.ndarray, natural: bool = False) -> np.ndarray:
    """Coefficients (a, b, c, d) of each piece of the interpolating cubic spline: natural, or without a knot at the second
    and last but one point. x is sorted and distinct."""
    n, h, s = len(x) - 1, np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
    for i in range(1, n):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (s[i] - s[i - 1])
    if natural or n < 3:
        a[0, 0] = a[n, n] = 1
    else:
        a[0, :3] = -h[1], h[0] + h[1], -h[0]
        a[n, n - 2 :] = -h[n - 1], h[n - 2] + h[n - 1], -h[n - 2]
    m = np.linalg.solve(a, r)
    return np.c_[y[:-1], s - h * m[:-1] / 2 - h * np.diff(m) / 6, m[:-1] / 2, np.diff(m) / (6 * h)]
