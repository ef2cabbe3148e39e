"""Recurrent layers over the embeddings as sequences, made-up tables, recovered components, gaps and regression trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenark.operators import classify, cluster, recurrent, sequence
from lumenark.plans.kit import Query, rounded, table
from lumenark.plans.vector_queries import _E, _sql, vectors
from lumenark.sources import generators

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FEATURES, WIDTH = 8, 2


def _weights(rows: int, columns: int, shift: int) -> np.ndarray:
    """Weights between -0.3 and 0.3 by a rule that SQL can repeat."""
    return (np.add.outer(np.arange(rows) * 3, np.arange(columns) * 5) + shift) % 7 / 10 - 0.3


def _cell(kind: str, features: int = FEATURES, shift: int = 0) -> recurrent.Cell:
    n = recurrent.GATES[kind] * WIDTH
    return recurrent.Cell(kind, _weights(features, n, shift), _weights(WIDTH, n, shift + 1), _weights(1, n, shift + 2)[0])


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]::DOUBLE[]"


def _inputs(cell: recurrent.Cell, frm: str, values: str) -> str:
    """(vec_id, t, n, g): each step's inputs to the gates."""
    gates = (f"list_dot_product({values}, {_list(cell.wx[:, j].tolist())}) + {cell.b[j]}" for j in range(len(cell.b)))
    return f"SELECT vec_id, t, n, {_list(gates)} AS g FROM {frm}"


def _steps(name: str, cell: recurrent.Cell, inputs: str) -> str:
    """The recursion of a cell: (vec_id, t, n, h), where h is the state and, for a memory cell, the memory after it."""
    u, w = cell.wh, WIDTH

    def gate(j: int, h=lambda k: f"h[{k + 1}]") -> str:
        return f"g[{j + 1}] + " + " + ".join(f"{h(k)} * {u[k, j]}" for k in range(w))

    def logistic(j: int) -> str:
        return f"(1 / (1 + exp(-({gate(j)}))))"

    if cell.kind == "plain":
        state = [f"tanh({gate(j)})" for j in range(w)]
    elif cell.kind == "gated":
        a = [f"tanh({gate(2 * w + j, lambda k: f'{logistic(k)} * h[{k + 1}]')})" for j in range(w)]
        state = [f"{logistic(w + j)} * (h[{j + 1}] - {a[j]}) + {a[j]}" for j in range(w)]
    else:
        c = [f"({logistic(j)} * h[{w + j + 1}] + {logistic(w + j)} * tanh({gate(3 * w + j)}))" for j in range(w)]
        state = [f"{logistic(2 * w + j)} * tanh({c[j]})" for j in range(w)] + c
    return f"{name}p AS ({inputs}), {name} AS (SELECT DISTINCT vec_id, -1::BIGINT AS t, n, {_list([0.0] * len(state))} AS h FROM {name}p UNION ALL SELECT r.vec_id, r.t + 1, r.n, {_list(state)} FROM {name} r JOIN {name}p p ON p.vec_id = r.vec_id AND p.t = r.t + 1)"


_PARTS = f"WITH RECURSIVE {_E}, s AS (SELECT vec_id, unnest(range(0, len(x) // {FEATURES})) AS t, len(x) // {FEATURES} AS n, x FROM e), q AS (SELECT vec_id, t, n, x[{FEATURES} * t + 1 : {FEATURES} * t + {FEATURES}] AS v FROM s)"


def _out(states: str) -> str:
    return f"SELECT vec_id, pos::INTEGER AS pos, round(y, 7) + 0.0::DOUBLE AS y FROM ({states})"


def _each(frm: str, width: int, offset: int = 0, at: str = "t", stride: int | None = None, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, ({at}) * {stride or width} + {offset + j} AS pos, h[{first + j + 1}] AS y FROM {frm} WHERE t >= 0" for j in range(width))


def _register(name: str, layer, sql: str, column: str = "states") -> None:
    def query(spark, sf_dir):
        out = recurrent.apply(vectors(spark, sf_dir), "vec_id", "x", FEATURES, layer)
        return out.select("vec_id", F.posexplode(column).alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 7).alias("y"))

    QUERIES[name], SQL[name] = query, sql


for kind in recurrent.GATES:
    one, two = _cell(kind), _cell(kind, WIDTH, 3)
    forward = _steps("a", one, _inputs(one, "q", "v"))
    _register(f"rnn_{kind}_layer", one, f"{_PARTS}, {forward} {_out(_each('a', WIDTH))}")
    below = f"(SELECT vec_id, t, n, h[1:{WIDTH}] AS v FROM a WHERE t >= 0)"
    _register(f"rnn_{kind}_stacked", recurrent.stacked([one, two]), f"{_PARTS}, {forward}, {_steps('b', two, _inputs(two, below, 'v'))} {_out(_each('b', WIDTH))}")
    back = _steps("b", one, _inputs(one, "(SELECT vec_id, n - 1 - t AS t, n, v FROM q)", "v"))
    _register(f"rnn_{kind}_both_ways", recurrent.both_ways(one, one), f"{_PARTS}, {forward}, {back} {_out(_each('a', WIDTH, stride=2 * WIDTH) + ' UNION ALL ' + _each('b', WIDTH, WIDTH, 'n - 1 - t', 2 * WIDTH))}")
    held = WIDTH * (2 if kind == "memory" else 1)
    _register(f"rnn_{kind}_last", one, f"{_PARTS}, {forward} {_out(_each('(SELECT * FROM a WHERE t = n - 1)', held, at='0'))}", "last")


def pca_recover(spark, sf_dir):
    """Vectors brought back from all their principal components, which are their z-scores."""
    df = vectors(spark, sf_dir)
    m, s, basis = cluster.principal(df, 1 - 1e-12)
    centred = F.zip_with("x", F.lit(m.tolist()), lambda v, u: v - u)
    z = df.select("vec_id", F.zip_with(centred, F.lit(s.tolist()), lambda v, u: v / u).alias("s"))
    back = cluster.recovered(z.select("vec_id", cluster.projected(F.col("s"), basis.T).alias("z")), basis)
    return back.select("vec_id", F.posexplode("r").alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 5).alias("y"))


QUERIES["pca_recover"] = pca_recover
SQL["pca_recover"] = _sql("SELECT vec_id, i::INTEGER AS pos, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 5) + 0.0::DOUBLE AS y FROM l WINDOW w AS (PARTITION BY i)")


def kmeans_gap(spark, sf_dir):
    """Gaps of k = 1..3 over values and hours of the events, and which of them is the largest."""
    e = table(spark, sf_dir, "events").select("event_id", F.array(F.col("value").cast("double"), F.hour("ts").cast("double")).alias("x")).where("x[0] is not null")
    ks = [1, 2, 3]
    errors = [cluster.best_of(e, "event_id", k, 1, 3)[1] for k in ks]
    best, gaps = cluster.gap_statistic(e, "event_id", ks, errors, 2, 3)
    return spark.createDataFrame([(k, g, i == best) for i, (k, g) in enumerate(zip(ks, gaps, strict=True))], "k int, gap double, best boolean")


QUERIES["kmeans_gap"] = kmeans_gap


def tree_regression(spark, sf_dir):
    """The leaves of a pruned regression tree of prices: rows and their mean, which is the leaf's value."""
    df = table(spark, sf_dir, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")))
    tree = classify.prune(classify.grow_regression_tree(df, ["l_quantity", "l_discount"], "l_extendedprice", 3, bins=16), 1e6)
    return df.groupBy(rounded(tree.column(), 4).alias("value")).agg(F.count("*").alias("n"), rounded(F.avg("l_extendedprice"), 4).alias("mean"))


QUERIES["tree_regression"] = tree_regression


def make_spiral(spark, sf_dir):
    return generators.spiral(spark, 1000, 3, noise=0.0).select("id", "arm", rounded(F.col("x0"), 9).alias("x0"), rounded(F.col("x1"), 9).alias("x1"))


QUERIES["make_spiral"] = make_spiral
SQL["make_spiral"] = "SELECT id, (id // 1000)::INTEGER AS arm, round(r * cos(4 * (r + id // 1000)), 9) + 0.0::DOUBLE AS x0, round(r * sin(4 * (r + id // 1000)), 9) + 0.0::DOUBLE AS x1 FROM (SELECT id, (id % 1000) / 1000.0::DOUBLE AS r FROM range(0, 3000) t(id))"


def make_wave_grid(spark, sf_dir):
    return generators.wave_grid(spark).select("id", "x", rounded(F.col("y"), 9).alias("y"))


QUERIES["make_wave_grid"] = make_wave_grid
SQL["make_wave_grid"] = "SELECT id, id / 10.0::DOUBLE AS x, round(2 * sin(id / 10.0::DOUBLE) + pow(id / 10.0::DOUBLE, 0.8), 9) + 0.0::DOUBLE AS y FROM range(0, 50) t(id)"


def transformer_decode(spark, sf_dir):
    """Every vector's second half decoded against its encoded first half."""
    halves = vectors(spark, sf_dir).select("vec_id", F.slice("x", 1, 32).alias("source"), F.slice("x", 33, 32).alias("target"))
    encode, decode = sequence.encoder(FEATURES), sequence.Decoder(FEATURES)
    y = sequence.map_pairs(halves, "vec_id", "target", "source", lambda x, m: decode(x, encode(m)), FEATURES)
    return y.select("vec_id", F.posexplode("y").alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 7).alias("y"))


QUERIES["transformer_decode"] = transformer_decode
