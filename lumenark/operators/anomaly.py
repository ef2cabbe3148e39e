"""Isolation and random-cut forests: trees grow on small hashed samples, rows are scored by one Arrow pass.

A tree's sample is chosen by a hash of the row's key and the tree's number, so results do not depend on partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe))


def samples(df: DataFrame, key: str, features: list[str], trees: int, size: int) -> dict[int, np.ndarray]:
    """trees arrays of at most `size` rows each; rows go to a tree by hash, the least hashes first: bounded by trees x size."""
    total = max(df.count(), 1)
    share = min(1.0, 2.0 * size / total)
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(key), t), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = df.select(F.col(key).alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.explode(picks).alias("t"))
    best = rows.groupBy("t").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("key", "t").alias("h"), "x"))), 1, size).alias("s"))
    return {r.t: np.array([p.x for p in r.s]) for r in best.collect()}


def isolation_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, n); feature -1 is a leaf. Cuts are uniform in the range of a random varying feature."""
    nodes: list[tuple] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(part)))
        low, high = part.min(0), part.max(0)
        varying = np.flatnonzero(high > low)
        if len(part) > 1 and len(varying) and depth < 60:
            f = int(rng.choice(varying))
            cut = float(rng.uniform(low[f], high[f]))
            left = part[:, f] < cut
            if left.any() and not left.all():
                nodes[at] = (f, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1), len(part))
        return at

    grow(x, 0)
    return nodes


def path_lengths(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, n = (np.array(c) for c in zip(*nodes, strict=True))
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    inner = feature[at] >= 0
    while inner.any():
        i = np.flatnonzero(inner)
        f = feature[at[i]]
        at[i] = np.where(x[i, f] < cut[at[i]], left[at[i]], right[at[i]])
        depth[i] += 1
        inner = feature[at] >= 0
    return depth + average_path(n[at])


def isolation_scores(df: DataFrame, key: str, features: list[str], trees: int = 50, size: int = 256, seed: int = 7) -> DataFrame:
    """(key, score): 2 ** -(mean path length / average path length of a sample); high is anomalous. Null features count as 0."""
    filled = df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    forest = [(isolation_tree(x, np.random.default_rng([seed, t])), len(x)) for t, x in sorted(samples(filled, key, features, trees, size).items())]

    def score(batches):
        for b in batches:
            x = b[features].to_numpy(float)
            total = sum((path_lengths(nodes, x) for nodes, _ in forest), np.zeros(len(x)))
            c = float(average_path(np.mean([n for _, n in forest]))) if forest else 1.0
            yield pd.DataFrame({key: b[key], "score": 2.0 ** (-total / max(len(forest), 1) / max(c, 1e-9))})

    return filled.mapInPandas(score, f"{key} {dict(filled.dtypes)[key]}, score double")


def cut_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, n, low, high) of a robust random cut tree: features in proportion to their range."""
    nodes: list[tuple] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        low, high = part.min(0), part.max(0)
        nodes.append((-1, 0.0, -1, -1, len(part), low, high))
        width = high - low
        if len(part) > 1 and width.sum() > 0 and depth < 60:
            f = int(rng.choice(len(width), p=width / width.sum()))
            cut = float(rng.uniform(low[f], high[f]))
            left = part[:, f] <= cut
            if left.any() and not left.all():
                nodes[at] = (f, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1), len(part), low, high)
        return at

    grow(x, 0)
    return nodes


def displacement(nodes: list[tuple], x: np.ndarray) -> float:
    """The largest ratio of a sibling's rows to the rows displaced with the point, along its path."""
    at, best, siblings = 0, 0.0, []
    while nodes[at][0] >= 0:
        f, cut, left, right, *_ = nodes[at]
        here, other = (left, right) if x[f] <= cut else (right, left)
        siblings.append((nodes[other][4], nodes[here][4]))
        at = here
    low, high = nodes[at][5], nodes[at][6]
    if (x < low).any() or (x > high).any():
        best = float(nodes[at][4])  # the point alone is cut off from the leaf
    for other, own in siblings:
        best = max(best, other / (own + 1))
    return best


def cut_scores(df: DataFrame, key: str, features: list[str], trees: int = 20, size: int = 256, seed: int = 7) -> DataFrame:
    """(key, score): the mean collusive displacement of each row in a forest of random cut trees."""
    filled = df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    forest = [cut_tree(x, np.random.default_rng([seed, t])) for t, x in sorted(samples(filled, key, features, trees, size).items())]

    def score(batches):
        for b in batches:
            x = b[features].to_numpy(float)
            yield pd.DataFrame({key: b[key], "score": [float(np.mean([displacement(t, v) for t in forest])) if forest else 0.0 for v in x]})

    return filled.mapInPandas(score, f"{key} {dict(filled.dtypes)[key]}, score double")


def check_threshold(value: float) -> float:
    if not 0.5 < value < 1:
        raise ValueError("a threshold lies between 0.5 and 1")
    return value


def score_of_paths(mean_path: float, size: int) -> float:
    return math.pow(2.0, -mean_path / float(average_path(size)))
