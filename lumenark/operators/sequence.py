"""Recurrent cells and transformer blocks over one sequence a row, by folds of arrays or NumPy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnn(x: Column, wx: float, wh: float, b: float = 0.0) -> Column:
    """The last state of a one-unit recurrent cell over an array: h' = tanh(wx * x + wh * h + b)."""
    return F.aggregate(x, F.lit(0.0), lambda h, v: F.tanh(v * wx + h * wh + b))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gru(x: Column, w: dict[str, float]) -> Column:
    """A one-unit gated cell: h' = z * (h - a) + a, with a = tanh(x wa + r h ua)."""

    def step(h, v):
        r, z = _logistic(v * w["wr"] + h * w["ur"]), _logistic(v * w["wz"] + h * w["uz"])
        a = F.tanh(v * w["wa"] + r * h * w["ua"])
        return z * (h - a) + a

    return F.aggregate(x, F.lit(0.0), step)


def lstm(x: Column, w: dict[str, float]) -> Column:
    """A one-unit memory cell; gates forget, in, out, then the candidate."""

    def step(s, v):
        f, i, o = (_logistic(v * w[f"w{g}"] + s["h"] * w[f"u{g}"]) for g in "fio")
        c = f * s["c"] + i * F.tanh(v * w["ws"] + s["h"] * w["us"])
        return F.struct((o * F.tanh(c)).alias("h"), c.alias("c"))

    return F.aggregate(x, F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("c")), step)["h"]


def map_sequences(df: DataFrame, key: str, column: str, f: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(key, y): f of each row's sequence, an array of rows of `width`; batches are stacked where lengths agree."""

    def run(batches):
        for b in batches:
            out = [f(np.asarray(v, float).reshape(-1, width)).ravel().tolist() if v is not None else None for v in b[column]]
            yield pd.DataFrame({key: b[key], "y": out})

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, y array<double>")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + epsilon)


def positions(length: int, width: int) -> np.ndarray:
    angle = np.arange(length)[:, None] / 10000 ** (2 * (np.arange(width) // 2) / width)
    return np.where(np.arange(width) % 2 == 0, np.sin(angle), np.cos(angle))


class EncoderBlock:
    """Multi-head self-attention and a two-layer network, each with residual and normalisation; weights from a seed."""

    def __init__(self, width: int, heads: int = 2, hidden: int = 16, seed: int = 3, causal: bool = False):
        r = np.random.default_rng(seed)
        self.heads, self.causal = heads, causal
        self.q, self.k, self.v, self.o = (r.normal(0, width**-0.5, (width, width)) for _ in range(4))
        self.w1, self.w2 = r.normal(0, width**-0.5, (width, hidden)), r.normal(0, hidden**-0.5, (hidden, width))

    def attend(self, x: np.ndarray, memory: np.ndarray | None = None, valid: int | np.ndarray | None = None) -> np.ndarray:
        """Attention of the rows of x to those of memory, or to their own; to the first `valid` of them, for each row of x
        or for all."""
        m = x if memory is None else memory
        q, k, v = (a.reshape(len(a), self.heads, -1).swapaxes(0, 1) for a in (x @ self.q, m @ self.k, m @ self.v))
        s = q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])
        if self.causal and memory is None:
            s = np.where(np.tril(np.ones(s.shape[1:], bool)), s, -1e10)
        if valid is not None:
            s = np.where(np.arange(s.shape[2]) < np.broadcast_to(valid, len(x))[:, None], s, -1e10)
        return (softmax(s) @ v).swapaxes(0, 1).reshape(x.shape) @ self.o

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = layer_norm(x + self.attend(x))
        return layer_norm(x + np.maximum(x @ self.w1, 0) @ self.w2)


def encoder(width: int, blocks: int = 2, **options) -> Callable[[np.ndarray], np.ndarray]:
    """Positions added, then the blocks."""
    stack = [EncoderBlock(width, seed=3 + i, **options) for i in range(blocks)]

    def run(x: np.ndarray) -> np.ndarray:
        x = x + positions(len(x), width)
        for b in stack:
            x = b(x)
        return x

    return run


class DecoderBlock:
    """Attention to the rows so far, then to an encoder's output, then a two-layer network, each with residual and norm."""

    def __init__(self, width: int, heads: int = 2, hidden: int = 16, seed: int = 3):
        self.own, self.cross = EncoderBlock(width, heads, hidden, seed), EncoderBlock(width, heads, hidden, seed + 1000)

    def __call__(self, x: np.ndarray, memory: np.ndarray, valid: int | None = None, before: np.ndarray | None = None) -> np.ndarray:
        """`before` are this block's inputs for earlier rows, where rows come one after another."""
        seen = x if before is None else np.concatenate([before, x])
        x = layer_norm(x + self.own.attend(x, seen, np.arange(len(seen) - len(x), len(seen)) + 1))
        x = layer_norm(x + self.cross.attend(x, memory, valid))
        return layer_norm(x + np.maximum(x @ self.cross.w1, 0) @ self.cross.w2)


class Decoder:
    """Positions added, then the blocks, over rows of `width` and an encoder's output of as many places a row."""

    def __init__(self, width: int, blocks: int = 2, **options):
        self.width, self.blocks = width, [DecoderBlock(width, seed=3 + i, **options) for i in range(blocks)]

    def __call__(self, x: np.ndarray, memory: np.ndarray, valid: int | None = None) -> np.ndarray:
        return self.following(x, memory, [None] * len(self.blocks), valid)[0]

    def following(self, x: np.ndarray, memory: np.ndarray, before: list, valid: int | None = None) -> tuple[np.ndarray, list]:
        """(outputs of the next rows, what to pass as `before` for those after them); at first `before` holds None for each block."""
        at = 0 if before[0] is None else len(before[0])
        x, after = x + positions(at + len(x), self.width)[at:], []
        for block, seen in zip(self.blocks, before, strict=True):
            after.append(x if seen is None else np.concatenate([seen, x]))
            x = block(x, memory, valid, seen)
        return x, after


def embedded(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's rows for ids, by the root of their width, as an embedding encoder or decoder reads them."""
    return table[ids] * np.sqrt(table.shape[1])


def map_pairs(df: DataFrame, key: str, target: str, source: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(key, y): f of each row's target and source sequences, arrays of rows of `width`; null where one of them is null."""

    def run(batches):
        for b in batches:
            pairs = zip(b[target], b[source], strict=True)
            out = [None if v is None or w is None else f(*(np.asarray(a, float).reshape(-1, width) for a in (v, w))).ravel().tolist() for v, w in pairs]
            yield pd.DataFrame({key: b[key], "y": out})

    return df.select(key, target, source).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, y array<double>")
