"""Vector recurrent layers, made-up tables, gaps, regression trees and pruning against NumPy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.operators import classify, cluster, recurrent, sequence
from lumenark.sources import generators


def by_hand(cell, x):
    n, out = cell.width, []
    h, c = np.zeros(n), np.zeros(n)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for v in x:
        gx = v @ cell.wx + cell.b
        if cell.kind == "plain":
            h = np.tanh(gx + h @ cell.wh)
        elif cell.kind == "gated":
            r, z = sig(gx[:n] + h @ cell.wh[:, :n]), sig(gx[n : 2 * n] + h @ cell.wh[:, n : 2 * n])
            a = np.tanh(gx[2 * n :] + (r * h) @ cell.wh[:, 2 * n :])
            h = z * h + (1 - z) * a
        else:
            f, i, o, s = np.split(gx + h @ cell.wh, 4)
            c = sig(f) * c + sig(i) * np.tanh(s)
            h = sig(o) * np.tanh(c)
        out.append(h)
    return np.array(out).reshape(len(x), n)


@pytest.mark.parametrize("kind", sorted(recurrent.GATES))
def test_layers_of_rows_of_any_length(spark, kind):
    r = np.random.default_rng(1)
    data = [(i, r.normal(size=(n, 3)).ravel().tolist(), "extra") for i, n in enumerate([4, 0, 1, 4, 9])] + [(5, None, None)]
    df = spark.createDataFrame(data, "id int, x array<double>, states string")
    cell, upper = recurrent.seeded(kind, 3, 5), recurrent.seeded(kind, 5, 5, 2)
    got = {row.id: row for row in recurrent.apply(df, "id", "x", 3, cell).collect()}
    two = {row.id: row for row in recurrent.apply(df, "id", "x", 3, recurrent.stacked([cell, upper])).collect()}
    ways = {row.id: row for row in recurrent.apply(df, "id", "x", 3, recurrent.both_ways(cell, cell)).collect()}
    assert got[5].states is None and got[5].last is None and len(got) == 6
    for i, x, _ in data[:5]:
        x = np.reshape(x, (-1, 3))
        want = by_hand(cell, x)
        assert np.allclose(np.reshape(got[i].states, (-1, 5)), want)
        assert np.allclose(np.reshape(two[i].states, (-1, 5)), by_hand(upper, want))
        assert np.allclose(np.reshape(ways[i].states, (-1, 10)), np.c_[want, by_hand(cell, x[::-1])[::-1]])
        assert np.allclose(got[i].last[:5], want[-1] if len(x) else 0)


def test_a_state_carried_on_is_the_whole_sequence():
    x = np.random.default_rng(0).normal(size=(2, 7, 3))
    for kind in recurrent.GATES:
        cell = recurrent.seeded(kind, 3, 4)
        layer = recurrent.stacked([cell, recurrent.seeded(kind, 4, 4, 5)])
        whole, end = layer(x)
        first, state = layer(x[:, :3])
        rest, last = layer(x[:, 3:], state)
        assert np.allclose(np.concatenate([first, rest], 1), whole) and all(np.allclose(a, b) for a, b in zip(end, last, strict=True))


def test_made_up_tables(spark):
    s = generators.spiral(spark, 50, 3).toPandas()
    assert s.groupby("arm").size().tolist() == [50] * 3 and np.allclose(np.hypot(s.x0, s.x1), s.id % 50 / 50)
    d = generators.linear(spark, [2.0, -1.0], 3.0, 4000, 0.1).toPandas()
    left = d.y - (2 * d.x0 - d.x1 + 3)
    assert abs(left.std() - 0.1) < 0.01 and abs(d.x0.std() - 1) < 0.05 and abs(np.corrcoef(d.x0, d.x1)[0, 1]) < 0.06
    p = generators.polynomial(spark, [1.0, 2.0, 3.0], 0.5, 500, 0.0).toPandas()
    assert np.allclose(p.y, p.x + 2 * p.x**2 + 3 * p.x**3 + 0.5) and np.allclose(p.x3, p.x**3)
    w = generators.wave(spark, 2000).toPandas()
    assert w.x.between(0, 5).all() and abs((w.y - 2 * np.sin(w.x) - w.x**0.8).std() - 0.5) < 0.05
    m = generators.mixture(spark, [1.0, 3.0], [[0.0, 0.0], [9.0, 1.0]], [[[1.0, 0.0], [0.0, 1.0]], [[2.0, 1.0], [1.0, 2.0]]], 4000).toPandas()
    x = np.stack(m.x[m.part == 1])
    assert abs(len(x) / 4000 - 0.75) < 0.03 and np.allclose(x.mean(0), [9, 1], atol=0.1) and np.allclose(np.cov(x.T), [[2, 1], [1, 2]], atol=0.2)
    assert generators.spiral(spark, 0).count() == 0


def test_gap_finds_two_groups(spark):
    r = np.random.default_rng(4)
    x = np.r_[r.normal(0, 0.3, (60, 2)), r.normal(8, 0.3, (60, 2))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").cache()
    errors = [cluster.best_of(df, "id", k, 3, 8)[1] for k in (1, 2)]
    assert errors[1] < errors[0] / 50
    best, gaps = cluster.gap_statistic(df, "id", [1, 2], errors, 2, 5)
    assert best == 1 and gaps[1] > gaps[0] and cluster.farthest_choice([0, best]) == 1
    assert cluster.gap_statistic(df, "id", [1], errors[:1])[0] == 0
    with pytest.raises(ValueError):
        cluster.best_of(df, "id", 0, 1)


def test_regression_tree_takes_the_best_cut_and_prunes(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 12, 400).astype(float), r.integers(0, 5, 400).astype(float)
    y = np.where(a <= 6, 1.0, 5.0) + np.where(b <= 1, 0.0, 1.5) + r.normal(0, 0.1, 400)
    rows = [(float(p), float(q), float(t)) for p, q, t in zip(a, b, y)]
    df = spark.createDataFrame(rows + [(1.0, 1.0, None)], "a double, b double, y double").cache()
    cost = lambda m: sum(((y[s] - y[s].mean()) ** 2).sum() for s in (m, ~m))
    _, feature, cut = min((cost(v <= c), f, c) for f, v in (("a", a), ("b", b)) for c in np.unique(v)[:-1])
    tree = classify.grow_regression_tree(df, ["a", "b"], "y", depth=3)
    assert (tree.feature, tree.cut, tree.n) == (feature, cut, 400) and np.isclose(tree.value, y.mean()) and np.isclose(tree.impurity, y.var())
    leaf = df.where("y is not null").groupBy(tree.column().alias("v")).agg(F.avg("y").alias("m")).collect()
    assert len(leaf) == tree.leaves() and all(np.isclose(v.v, v.m) for v in leaf)
    assert 4 <= tree.leaves() <= 8 and classify.prune(tree, 2.0).leaves() == 4 and classify.prune(tree, 1e9).leaves() == 1
    empty = classify.grow_regression_tree(df.where("false"), ["a"], "y")
    assert empty.leaves() == 1 and empty.value == 0.0


def test_pruning_a_classification_tree(spark):
    df = spark.createDataFrame([(float(i), "x" if i < 50 else "y") for i in range(100)], "a double, l string")
    tree = classify.grow_tree(df, ["a"], "l", depth=2)
    n = tree.leaves()
    assert n >= 2 and classify.prune(tree, 0.0).leaves() == n
    assert classify.prune(tree, 1e6).leaves() == 1 and tree.column() is not None


def test_covariance_and_recovery(spark):
    x = np.random.default_rng(3).normal(size=(300, 4)) @ np.random.default_rng(4).normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "id int, x array<double>").repartition(5)
    m, c, n = cluster.covariance(df)
    assert n == 300 and np.allclose(m, x.mean(0)) and np.allclose(c, np.cov(x.T, bias=True))
    m, s, basis = cluster.principal(df, 0.5)
    z = (x - m) / s
    back = cluster.recovered(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z @ basis)], "id int, z array<double>"), basis)
    assert basis.shape[1] < 4 and np.allclose([r.r for r in back.orderBy("id").collect()], z @ basis @ basis.T)
    assert cluster.covariance(df.where("false"))[2] == 1


def test_decoder_row_by_row_and_masks(spark):
    r = np.random.default_rng(6)
    x, memory = r.normal(size=(5, 8)), r.normal(size=(4, 8))
    decode = sequence.Decoder(8, 3)
    whole, before, got = decode(x, memory, 3), [None] * 3, []
    for row in x:
        y, before = decode.following(row[None], memory, before, 3)
        got.append(y[0])
    assert np.allclose(got, whole)
    # rows after a row and memory beyond the valid length change nothing; valid memory does
    assert np.allclose(decode(np.r_[x[:2], x[:3] + 1], memory, 3)[:2], whole[:2])
    other = memory.copy()
    other[3] += 5
    assert np.allclose(decode(x, other, 3), whole) and not np.allclose(decode(x, other), decode(x, memory))
    block = sequence.EncoderBlock(8)
    head = lambda a, w, h: (a @ w)[:, 4 * h : 4 * h + 4]
    want = np.zeros((5, 8))
    for i in range(5):
        for h in range(2):
            scores = np.exp([head(x, block.q, h)[i] @ head(memory, block.k, h)[j] / 2 for j in range(3)])
            want[i, 4 * h : 4 * h + 4] = scores / scores.sum() @ head(memory, block.v, h)[:3]
    assert np.allclose(block.attend(x, memory, 3), want @ block.o)
    table = r.normal(size=(6, 8))
    assert np.allclose(sequence.embedded(np.array([2, 0]), table), table[[2, 0]] * 8**0.5)
    rows = [(0, x.ravel().tolist(), memory.ravel().tolist()), (1, None, memory.ravel().tolist())]
    out = {v.id: v.y for v in sequence.map_pairs(spark.createDataFrame(rows, "id int, t array<double>, s array<double>"), "id", "t", "s", decode, 8).collect()}
    assert np.allclose(np.reshape(out[0], (5, 8)), decode(x, memory)) and out[1] is None
