"""Dropout, recurrent outputs in both directions and turn points, over the embeddings as rows or series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.functions import layers as L
from lumenark.functions import vector as V
from lumenark.plans.kit import Query, rounded
from lumenark.plans.vector_queries import _E, _long, _sql, _w, vectors, x

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _u(keys: str, seed: int = 1) -> str:
    """uniform() in SQL, of the sum of spread keys."""
    return f"((({keys} + {seed}) * {L.MULTIPLIER} % {L.MODULUS}) * {L.MULTIPLIER} % {L.MODULUS} / {float(L.MODULUS)})"


def _drop(keys: str, ratio: float, value: str = "v") -> str:
    return _w(f"CASE WHEN {_u(keys)} < {ratio} THEN 0 ELSE {value} / {1 - ratio} END")


_A, _B = L.SPREAD[:2]
ROW = lambda: F.col("vec_id")
LAYERS = {
    "layer_dropout": (lambda: L.dropout(x(), 0.5, ROW()), _drop(f"vec_id * {_A} + i * {_B}", 0.5)),
    "layer_dropout_evaluated": (lambda: L.dropout(x(), 0.5, ROW(), training=False), _w("v")),
    "layer_dropout_gradient": (lambda: L.dropout(V.softmax_gradient(x(), x()), 0.25, ROW()), _drop(f"vec_id * {_A} + i * {_B}", 0.25, "(v * (v - sum(v * v) OVER (PARTITION BY vec_id)))")),
    # rows are the time steps: one mask for all of them
    "layer_dropout_variational": (lambda: L.dropout(x(), 0.5), _drop(f"i * {_A}", 0.5)),
    # maps of 8 (one dimension), 4 by 4 and 2 by 4 by 4 places are dropped whole
    "layer_dropout_1d": (lambda: L.dropout(x(), 0.5, ROW(), reach=8), _drop(f"vec_id * {_A} + (i // 8) * {_B}", 0.5)),
    "layer_dropout_2d": (lambda: L.dropout(x(), 0.5, ROW(), reach=16), _drop(f"vec_id * {_A} + (i // 16) * {_B}", 0.5)),
    "layer_dropout_3d": (lambda: L.dropout(x(), 0.5, ROW(), reach=32), _drop(f"vec_id * {_A} + (i // 32) * {_B}", 0.5)),
}
for name, (value, sql) in LAYERS.items():
    QUERIES[name], SQL[name] = _long(value), sql


def rnn_bidirectional(spark, sf_dir):
    """The states of a layer read forward and backward, at every place of every vector."""
    both = vectors(spark, sf_dir).select("vec_id", F.posexplode(L.bidirectional(x(), 0.8, 0.5, 0.1)).alias("pos", "s"))
    return both.select("vec_id", "pos", rounded(F.col("s.forward"), 7).alias("forward"), rounded(F.col("s.backward"), 7).alias("backward"))


QUERIES["rnn_bidirectional"] = rnn_bidirectional
SQL["rnn_bidirectional"] = f"""WITH RECURSIVE {_E}, n AS (SELECT vec_id, x, len(x) AS n FROM e),
f AS (SELECT vec_id, 0 AS i, x, n, tanh(x[1] * 0.8 + 0.1) AS h, tanh(x[n] * 0.8 + 0.1) AS b FROM n UNION ALL SELECT vec_id, i + 1, x, n, tanh(x[i + 2] * 0.8 + h * 0.5 + 0.1), tanh(x[n - i - 1] * 0.8 + b * 0.5 + 0.1) FROM f WHERE i + 1 < n)
SELECT p.vec_id, p.i::INTEGER AS pos, round(p.h, 7) + 0.0::DOUBLE AS forward, round(q.b, 7) + 0.0::DOUBLE AS backward FROM f p JOIN f q ON p.vec_id = q.vec_id AND q.i = p.n - 1 - p.i"""


def series_turn_points(spark, sf_dir):
    """Turn points of every vector read as a series, two places apart."""
    return vectors(spark, sf_dir).select("vec_id", F.explode(L.turn_points(x(), 2)).alias("pos"))


QUERIES["series_turn_points"] = series_turn_points
SQL["series_turn_points"] = _sql("""SELECT * FROM (WITH a AS (SELECT vec_id, i, v, len(x) AS n, -atan((x[-1] - x[1]) / (len(x) - 1)) AS g FROM l JOIN e USING (vec_id)), r AS (SELECT vec_id, i, sin(g) * i + cos(g) * v AS y FROM a),
k AS (SELECT vec_id, i, (lag(y) OVER w - y) * (lead(y) OVER w - y) > 0 AS turn FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY i)), t AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM k WHERE turn)
SELECT vec_id, i::INTEGER AS pos FROM t QUALIFY (i - min(i) OVER (PARTITION BY vec_id, island)) % 2 = 0)""")
