"""Recurrent layers with vector states over one sequence a row: plain, gated and memory cells, stacked and in both directions.

A layer maps (rows, steps, features) to the states of all steps and the last state; rows of equal length in an Arrow batch
are stepped together. Weights travel with the function, so models must fit a task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: x of (rows, steps, features) and, if given, the first states, to (states of all steps, last states)
Layer = Callable[..., tuple[np.ndarray, tuple[np.ndarray, ...]]]


def logistic(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1, np.exp(-np.abs(x))) / (1 + np.exp(-np.abs(x)))


@dataclass(frozen=True)
class Cell:
    """One step of a layer; the columns of wx, wh and b lie gate by gate.

    plain: h' = tanh(x wx + h wh + b). gated, gates r, z, a: a = tanh(x wa + (r * h) ua + ba), h' = z * (h - a) + a.
    memory, gates f, i, o, s: c' = f * c + i * tanh(s), h' = o * tanh(c').
    """

    kind: str
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray

    @property
    def width(self) -> int:
        return len(self.wh)

    def start(self, rows: int) -> tuple[np.ndarray, ...]:
        return tuple(np.zeros((rows, self.width)) for _ in range(2 if self.kind == "memory" else 1))

    def step(self, inputs: np.ndarray, state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The next state; `inputs` is x wx + b."""
        h, n = state[0], self.width
        if self.kind == "plain":
            return (np.tanh(inputs + h @ self.wh),)
        if self.kind == "gated":
            g = logistic(inputs[:, : 2 * n] + h @ self.wh[:, : 2 * n])
            a = np.tanh(inputs[:, 2 * n :] + (g[:, :n] * h) @ self.wh[:, 2 * n :])
            return (g[:, n:] * (h - a) + a,)
        if self.kind == "memory":
            g = inputs + h @ self.wh
            f, i, o = np.split(logistic(g[:, : 3 * n]), 3, 1)
            c = f * state[1] + i * np.tanh(g[:, 3 * n :])
            return o * np.tanh(c), c
        raise ValueError(f"no cell of kind {self.kind}")

    def __call__(self, x: np.ndarray, state: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        state = self.start(len(x)) if state is None else state
        inputs, out = x @ self.wx + self.b, np.empty((*x.shape[:2], self.width))
        for t in range(x.shape[1]):
            state = self.step(inputs[:, t], state)
            out[:, t] = state[0]
        return out, state


GATES = {"plain": 1, "gated": 3, "memory": 4}


def seeded(kind: str, features: int, width: int, seed: int = 1) -> Cell:
    """A cell with normal weights of variance one over their inputs, and no bias."""
    r, n = np.random.default_rng(seed), GATES[kind] * width
    return Cell(kind, r.normal(0, features**-0.5, (features, n)), r.normal(0, width**-0.5, (width, n)), np.zeros(n))


def both_ways(forward: Layer, backward: Layer) -> Layer:
    """States of a layer that reads on beside those of one that reads back, at each step; last states side by side."""

    def run(x: np.ndarray, state: tuple[np.ndarray, ...] | None = None):
        halves = (None, None) if state is None else tuple(zip(*(np.split(s, 2, -1) for s in state), strict=True))
        y, s = forward(x, halves[0])
        z, t = backward(x[:, ::-1], halves[1])
        return np.concatenate([y, z[:, ::-1]], -1), tuple(np.concatenate(p, -1) for p in zip(s, t, strict=True))

    return run


def stacked(layers: list[Layer], between: Callable[[np.ndarray], np.ndarray] | None = None) -> Layer:
    """Each layer reads the states of the one before, changed by `between` (a norm, a dropout) if given; last states in a row."""

    def run(x: np.ndarray, state: tuple[np.ndarray, ...] | None = None):
        last: list[np.ndarray] = []
        held = list(state or ())
        each = len(held) // len(layers)
        for i, layer in enumerate(layers):
            x, s = layer(between(x) if between and i else x, tuple(held[i * each : (i + 1) * each]) if held else None)
            last += s
        return x, tuple(last)

    return run


def apply(df: DataFrame, key: str, column: str, features: int, layer: Layer) -> DataFrame:
    """(key, states, last): the layer over each row's flat sequence, `features` values a step; the states step by step in one
    array, the last states in another.

    A null sequence gives nulls; one without a step has no states and last states of zero; other columns are ignored.
    A sequence that does not end with a whole step is an error.
    """

    def run(batches):
        for b in batches:
            sequences = [None if v is None else np.asarray(v, float).reshape(-1, features) for v in b[column]]
            states, last = [None] * len(sequences), [None] * len(sequences)
            lengths: dict[int, list[int]] = {}
            for i, s in enumerate(sequences):
                if s is not None:
                    lengths.setdefault(len(s), []).append(i)
            for places in lengths.values():
                y, end = layer(np.stack([sequences[i] for i in places]))
                end = np.concatenate(end, -1)
                for i, a, z in zip(places, y, end, strict=True):
                    states[i], last[i] = a.ravel().tolist(), z.tolist()
            yield pd.DataFrame({key: b[key], "states": states, "last": last})

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, states array<double>, last array<double>")
