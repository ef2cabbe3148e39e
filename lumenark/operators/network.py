"""Feed-forward networks trained by synchronous steps: gradients are summed on the executors, weights live on the driver."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Network:
    """Layers of weights with ReLU between; the last layer is linear."""

    def __init__(self, sizes: list[int], seed: int = 1):
        r = np.random.default_rng(seed)
        self.layers = [(r.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            x = np.maximum(x, 0) if i + 1 < len(self.layers) else x
            out.append(x)
        return out

    def gradients(self, x: np.ndarray, t: np.ndarray, loss: str) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """(summed loss, summed gradients): 'mse' on one output, 'softmax' cross entropy on class indices."""
        acts = self.forward(x)
        y = acts[-1]
        if loss == "mse":
            d = y - t[:, None]
            total = float((d * d).sum() / 2)
        else:
            e = np.exp(y - y.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            hot = np.eye(y.shape[1])[t.astype(int)]
            total, d = float(-np.log(p[np.arange(len(t)), t.astype(int)] + 1e-8).sum()), p - hot
        out = []
        for i in range(len(self.layers) - 1, -1, -1):
            out.append((acts[i].T @ d, d.sum(0)))
            if i:
                d = (d @ self.layers[i][0].T) * (acts[i] > 0)
        return total, out[::-1]


def train(df: DataFrame, features: list[str], target: str, sizes: list[int], loss: str = "mse", epochs: int = 10, rate: float = 0.01, seed: int = 1, patience: int = 5) -> tuple[Network, list[float]]:
    """(network, mean loss of each epoch): one distributed pass an epoch, Adam on the driver; stops after `patience` epochs
    without a better loss. What comes back from a task is one row of summed gradients, whatever its rows."""
    net = Network([len(features), *sizes], seed)
    m = [[np.zeros_like(a) for a in layer] for layer in net.layers]
    v = [[np.zeros_like(a) for a in layer] for layer in net.layers]
    history: list[float] = []
    rows = df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), F.col(target).cast("double").alias(target))
    for epoch in range(1, epochs + 1):
        weights = pickle.dumps(net)

        def part(batches, weights=weights):
            local, total, n, sums = pickle.loads(weights), 0.0, 0, None
            for b in batches:
                if len(b):
                    l, g = local.gradients(b[features].to_numpy(float), b[target].to_numpy(float), loss)
                    total, n = total + l, n + len(b)
                    sums = g if sums is None else [tuple(x + y for x, y in zip(p, q, strict=True)) for p, q in zip(sums, g, strict=True)]
            if sums is not None:
                yield pd.DataFrame({"loss": [total], "n": [n], "g": [pickle.dumps(sums)]})

        got = rows.mapInPandas(part, "loss double, n long, g binary").collect()
        n = sum(r.n for r in got)
        if not n:
            break
        history.append(sum(r.loss for r in got) / n)
        parts = [pickle.loads(bytes(r.g)) for r in got]
        for i, layer in enumerate(net.layers):
            new = []
            for j, a in enumerate(layer):
                g = sum(p[i][j] for p in parts) / n
                m[i][j] = 0.9 * m[i][j] + 0.1 * g
                v[i][j] = 0.999 * v[i][j] + 0.001 * g * g
                new.append(a - rate * (m[i][j] / (1 - 0.9**epoch)) / (np.sqrt(v[i][j] / (1 - 0.999**epoch)) + 1e-8))
            net.layers[i] = tuple(new)
        if epoch - 1 - int(np.argmin(history)) > patience:
            break
    return net, history


def predict(df: DataFrame, key: str, features: list[str], net: Network) -> DataFrame:
    """(key, y): the outputs of each row."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "y": net.forward(b[features].fillna(0).to_numpy(float))[-1].tolist()})

    return df.select(key, *features).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, y array<double>")


def save(net: Network, df: DataFrame, path: str) -> None:
    """Parameters as a table (name, shape, values)."""
    rows = [(f"{i}.{n}", list(a.shape), a.ravel().tolist()) for i, layer in enumerate(net.layers) for n, a in zip("wb", layer, strict=True)]
    df.sparkSession.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(df: DataFrame) -> Network:
    rows = {r.name: np.array(r["values"]).reshape(r["shape"]) for r in df.collect()}
    net = Network([1, 1])
    net.layers = [(rows[f"{i}.w"], rows[f"{i}.b"]) for i in range(len(rows) // 2)]
    return net
