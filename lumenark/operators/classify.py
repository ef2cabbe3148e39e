"""Naive Bayes, discriminants, split search and trees. Models are small tables of sums; data is only aggregated and scored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, value, label, n) of continuous features, in one pass; a hot value is counted before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    return df.select(F.col(label).alias("label"), F.inline(pairs)).groupBy("feature", "value", "label").agg(F.count("*").alias("n"))


def class_splits(hist: DataFrame) -> DataFrame:
    """(feature, cut, entropy, gini): the weighted impurity of value <= cut against the rest, at midpoints of distinct values.

    Works on the histogram, whose windows hold the distinct values of one feature and label.
    """
    labels = hist.select("label").distinct()
    values = hist.groupBy("feature", "value").agg(F.sum("n").alias("all"))
    dense = values.join(F.broadcast(labels)).join(hist, ["feature", "value", "label"], "left").select("feature", "value", "label", F.coalesce("n", F.lit(0)).alias("n"))
    up = Window.partitionBy("feature", "label").orderBy("value")
    left = dense.withColumns({"l": F.sum("n").over(up), "t": F.sum("n").over(Window.partitionBy("feature", "label"))})
    sides = left.select("feature", "value", "l", (F.col("t") - F.col("l")).alias("r"))

    def part(c: str) -> list[Column]:
        return [F.sum(c).alias(f"{c}n"), F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0)).alias(f"{c}l"), F.sum(F.col(c) * F.col(c)).alias(f"{c}q")]

    s = sides.groupBy("feature", "value").agg(*part("l"), *part("r"))

    def entropy(c: str) -> Column:
        return F.when(F.col(f"{c}n") > 0, F.col(f"{c}n") * F.log2(f"{c}n") - F.col(f"{c}l")).otherwise(0.0)

    def gini(c: str) -> Column:
        return F.when(F.col(f"{c}n") > 0, F.col(f"{c}n") - F.try_divide(f"{c}q", f"{c}n")).otherwise(0.0)

    n = F.col("ln") + F.col("rn")
    following = F.lead("value").over(Window.partitionBy("feature").orderBy("value"))
    out = s.select("feature", "value", ((F.col("value") + following) / 2).alias("cut"), ((entropy("l") + entropy("r")) / n).alias("entropy"), ((gini("l") + gini("r")) / n).alias("gini"))
    return out.where("cut is not null").drop("value")


def variance_splits(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, cut, rss): the squared error of two means, at midpoints of distinct values."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    sums = df.select(F.col(target).alias("y"), F.inline(pairs)).groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    up, all_ = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    c = sums.select("feature", "value", *(F.sum(x).over(up).alias(f"l{x}") for x in "nsq"), *(F.sum(x).over(all_).alias(f"t{x}") for x in "nsq"), F.lead("value").over(up).alias("following"))
    right = {x: F.col(f"t{x}") - F.col(f"l{x}") for x in "nsq"}
    rss = F.col("lq") - F.col("ls") * F.col("ls") / F.col("ln") + right["q"] - F.try_divide(right["s"] * right["s"], right["n"])
    return c.where("following is not null").select("feature", ((F.col("value") + F.col("following")) / 2).alias("cut"), rss.alias("rss"))


@dataclass
class Node:
    """A node of a binary tree: the feature and cut it splits at, or a leaf's value."""

    value: float | str
    n: int
    feature: str | None = None
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    impurity: float = 0.0

    def column(self) -> Column:
        """The tree as nested conditions, evaluated inside code generation."""
        if self.feature is None or self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.cut, self.left.column()).otherwise(self.right.column())

    def leaves(self) -> int:
        return 1 if self.left is None or self.right is None else self.left.leaves() + self.right.leaves()


def grow_tree(df: DataFrame, features: list[str], label: str, depth: int = 3, least: int = 5, impurity: str = "gini", bins: int = 64) -> Node:
    """A classification tree, level by level: one aggregate over all data counts labels in quantile bins of every feature at
    every open node; what is collected is nodes x features x bins x labels numbers."""
    edges = {f: sorted(set(df.agg(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000)).first()[0] or [])) for f in features}
    root = Node("", 0)
    open_: dict[int, tuple[Node, Column]] = {0: (root, F.lit(True))}
    for level in range(depth + 1):
        if not open_:
            break
        node = F.coalesce(*(F.when(c, F.lit(i)) for i, (_, c) in open_.items()))
        binned = [F.struct(F.lit(f).alias("feature"), sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)).alias("bin")) for f in features]
        rows = df.select(node.alias("node"), F.col(label).alias("label"), F.inline(F.array(*binned))).where("node is not null").groupBy("node", "feature", "bin", "label").agg(F.count("*").alias("n")).collect()
        table: dict[int, dict[str, dict]] = {}
        for r in rows:
            table.setdefault(r.node, {}).setdefault(r.feature, {}).setdefault(r.bin, {})[r.label] = r.n
        following: dict[int, tuple[Node, Column]] = {}
        for i, (here, path) in open_.items():
            counts: dict = {}
            for b in table.get(i, {}).get(features[0], {}).values():
                for k, n in b.items():
                    counts[k] = counts.get(k, 0) + n
            here.n = sum(counts.values())
            here.value = max(sorted(counts), key=lambda k: counts[k], default="")
            here.impurity = _impurity(counts, impurity)
            if level == depth or len(counts) < 2 or here.n <= least:
                continue
            best = None
            for f in features:
                cells = table[i][f]
                left: dict = {}
                for at, edge in enumerate(edges[f]):
                    for k, n in cells.get(at, {}).items():
                        left[k] = left.get(k, 0) + n
                    nl = sum(left.values())
                    if nl in (0, here.n):
                        continue
                    right = {k: counts[k] - left.get(k, 0) for k in counts}
                    score = _impurity(left, impurity) * nl + _impurity(right, impurity) * (here.n - nl)
                    if best is None or score < best[0] - 1e-12:
                        best = (score, f, edge)
            if best is None or best[0] >= _impurity(counts, impurity) * here.n - 1e-12:
                continue
            here.feature, here.cut, here.left, here.right = best[1], best[2], Node(here.value, 0), Node(here.value, 0)
            following[2 * i + 1] = (here.left, path & (F.col(best[1]) <= best[2]))
            following[2 * i + 2] = (here.right, path & (F.col(best[1]) > best[2]))
        open_ = following
    return root


def grow_regression_tree(df: DataFrame, features: list[str], target: str, depth: int = 3, least: int = 5, bins: int = 64) -> Node:
    """A regression tree of means, level by level, that lessens the sum of squares most; of equal cuts the first.

    What is collected is nodes x features x bins triples of sums. Rows without a target are left out; a null feature goes right.
    """
    df = df.where(F.col(target).isNotNull())
    edges = {f: sorted(set(df.agg(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000)).first()[0] or [])) for f in features}
    mean = df.agg(F.avg(target)).first()[0] or 0.0  # sums of squares about the mean keep their digits
    t = F.col(target) - mean
    root = Node(mean, 0)
    open_: dict[int, tuple[Node, Column]] = {0: (root, F.lit(True))}
    for level in range(depth + 1):
        if not open_:
            break
        node = F.coalesce(*(F.when(c, F.lit(i)) for i, (_, c) in open_.items()))
        binned = [F.struct(F.lit(f).alias("feature"), sum((F.when(F.col(f) <= e, 0).otherwise(1) for e in edges[f]), F.lit(0)).alias("bin")) for f in features]
        sums = df.select(node.alias("node"), t.alias("t"), F.inline(F.array(*binned))).where("node is not null").groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"))
        cells: dict[tuple, np.ndarray] = {}
        for r in sums.collect():
            cells.setdefault((r.node, r.feature), np.zeros((len(edges[r.feature]) + 1, 3)))[r.bin] = r.n, r.s, r.q
        following: dict[int, tuple[Node, Column]] = {}
        for i, (here, path) in open_.items():
            if (i, features[0]) not in cells:
                continue
            n, s, q = cells[i, features[0]].sum(0)
            here.n, here.value, here.impurity = int(n), float(mean + s / n), float(max(q / n - (s / n) ** 2, 0.0))
            if level == depth or n <= least:
                continue
            best = None
            for f in features:
                left = cells[i, f].cumsum(0)[:-1]
                right = (n, s, q) - left
                for at in np.flatnonzero((left[:, 0] > 0) & (right[:, 0] > 0)):
                    score = sum(float(x[2] - x[1] ** 2 / x[0]) for x in (left[at], right[at]))
                    if best is None or score < best[0] - 1e-9:
                        best = (score, f, edges[f][at])
            if best is None or best[0] >= here.impurity * n - 1e-9:
                continue
            here.feature, here.cut, here.left, here.right = best[1], best[2], Node(here.value, 0), Node(here.value, 0)
            following[2 * i + 1] = (here.left, path & F.coalesce(F.col(best[1]) <= best[2], F.lit(False)))
            following[2 * i + 2] = (here.right, path & ~F.coalesce(F.col(best[1]) <= best[2], F.lit(False)))
        open_ = following
    return root


def prune(root: Node, alpha: float) -> Node:
    """The tree, cut back from below: a node becomes a leaf where the rows' impurity and alpha for each leaf do not grow by it.

    Levels go from the lowest up, until one has nothing to cut.
    """
    levels = [[root]]
    while levels[-1]:
        levels.append([c for n in levels[-1] for c in (n.left, n.right) if c is not None])

    def cost(n: Node) -> float:
        return n.n * n.impurity + alpha if n.left is None or n.right is None else cost(n.left) + cost(n.right)

    # the level above the lowest leaves is the first that can change
    for level in reversed(levels[:-2]):
        cut = False
        for n in level:
            if n.left is not None and n.right is not None and n.n * n.impurity + alpha <= cost(n):
                n.left = n.right = n.feature = None
                cut = True
        if not cut:
            break
    return root


def _impurity(counts: dict, kind: str) -> float:
    n = sum(counts.values())
    shares = [c / n for c in counts.values() if c] if n else []
    return 1 - sum(s * s for s in shares) if kind == "gini" else -sum(s * math.log2(s) for s in shares)


def discriminant(df: DataFrame, features: list[str], label: str, quadratic: bool = False) -> dict:
    """{label: Column}: the discriminant of each class, from one aggregate of sums by class.

    Linear: the total scatter over n - K as the common covariance; quadratic: each class's own over n_c - 1.
    """
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(features) for b in features[i:]]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *(F.sum(a).alias(a) for a in features), *sums).collect()
    n = sum(r.n for r in rows)

    def cross(r) -> np.ndarray:
        return np.array([[r[f"{a}|{b}"] if f"{a}|{b}" in r else r[f"{b}|{a}"] for b in features] for a in features])

    total, mean = sum(cross(r) for r in rows), np.array([sum(r[a] for r in rows) for a in features]) / n
    common = np.linalg.inv((total - n * np.outer(mean, mean)) / (n - len(rows)))
    out = {}
    for r in rows:
        mu = np.array([r[a] for a in features]) / r.n
        inverse = np.linalg.inv((cross(r) - r.n * np.outer(mu, mu)) / (r.n - 1)) if quadratic else common
        x = [F.col(a) - float(m) for a, m in zip(features, mu, strict=True)]
        distance = sum((float(inverse[i, j]) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
        out[r[label]] = F.lit(math.log(r.n / n) + (0.5 * float(np.linalg.slogdet(inverse)[1]) if quadratic else 0.0)) - 0.5 * distance
    return out
