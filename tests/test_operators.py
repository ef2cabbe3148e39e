"""Operators against NumPy and closed forms."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.functions import text as T
from lumenark.operators import anomaly, classify, cluster, network, regression, sampling, sequence, series, stats
from lumenark.sources import readers
from lumenark.streaming import windows


def test_least_squares_is_numpys(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = 2 + x @ [1.0, -3.0, 0.0] + r.normal(size=200)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double")
    cols = {n: F.col(n) for n in "abc"}
    fit = regression.fit_linear(df, cols, F.col("y"))
    m = np.c_[np.ones(200), x]
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert np.allclose(fit.beta, beta) and np.isclose(fit.rss, rss[0])
    assert np.allclose(fit.std, np.sqrt(rss[0] / 196 * np.diag(np.linalg.inv(m.T @ m))))
    assert fit.p_values[2] < 1e-6 < fit.p_values[3]
    g = regression.grams(df, cols, F.col("y"))[None]
    assert regression.best_subsets(g)[1].names == ["a", "b"] and regression.forward(g)[0].names == ["b"]
    assert [len(f.names) for f in regression.backward(g)] == [3, 2, 1]
    assert np.all(regression.inflation(g) >= 1)


def test_singular_features_take_the_least_norm_solution(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i) for i in range(20)], "a double, b double, y double")
    fit = regression.solve(regression.grams(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y"))[None])
    assert fit.rss < 1e-6


def test_weibull_and_logistic(spark):
    r = np.random.default_rng(3)
    w = spark.createDataFrame([(float(v),) for v in 3.5 * r.weibull(2.5, 2000)], "v double")
    shape, scale = regression.fit_weibull(w, "v")
    assert abs(shape - 2.5) < 0.15 and abs(scale - 3.5) < 0.1
    x = r.normal(size=1500)
    t = (r.random(1500) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, t)], "x double, t double")
    theta, _ = regression.fit_logistic(df, {"x": F.col("x")}, F.col("t"), ridge=0.01)
    assert abs(theta[0] - 0.5) < 0.25 and abs(theta[1] - 2) < 0.35


def test_cubic_spline_repeats_a_cubic():
    x = np.linspace(0, 4, 7)
    c = regression.cubic_spline(x, x**3)
    mid = x[:-1] + 0.3
    assert np.allclose(c[:, 0] + c[:, 1] * 0.3 + c[:, 2] * 0.09 + c[:, 3] * 0.027, mid**3)
    natural = regression.cubic_spline(x, np.sin(x), natural=True)
    assert abs(natural[0, 2]) < 1e-12


def test_runs_and_tails(spark):
    assert stats.runs_left(2, 2, 4) == pytest.approx(1.0) and stats.runs_left(2, 2, 2) == pytest.approx(2 / 6)
    assert stats.runs_left(0, 5, 1) == 0.0
    assert stats.survival(spark, "NormalDistribution", 0.0, 0, 1) == pytest.approx(0.5)
    assert stats.quantile(spark, "TDistribution", 0.975, 10) == pytest.approx(2.2281, abs=1e-3)


def test_row_numbers_with_ties(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 7)], "v int, id int")
    got = series.global_row_number(df, ["v", "id"], parts=4).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 53)) and got[0].v is None


def test_tree_splits_where_classes_do(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), "a" if i < 40 else "b") for i in range(100)], "x double, z double, y string")
    tree = classify.grow_tree(df, ["x", "z"], "y", depth=2)
    assert tree.feature == "x" and abs(tree.cut - 39) <= 2
    assert df.where(tree.column() != F.col("y")).count() <= 2 and tree.leaves() >= 2


def test_discriminants(spark):
    r = np.random.default_rng(1)
    pts = [(float(a), float(b), "p") for a, b in r.normal(0, 1, (80, 2))] + [(float(a), float(b), "q") for a, b in r.normal(5, 1, (80, 2))]
    df = spark.createDataFrame(pts, "a double, b double, y string")
    for quadratic in (False, True):
        s = classify.discriminant(df, ["a", "b"], "y", quadratic)
        assert df.where((s["p"] > s["q"]) != (F.col("y") == "p")).count() <= 2


def test_lloyd_and_components(spark):
    r = np.random.default_rng(2)
    x = np.r_[r.normal(0, 0.1, (30, 3)), r.normal(4, 0.1, (30, 3))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, x array<double>")
    for median in (False, True):
        c, _ = cluster.lloyd(df, x[[0, 59]], 10, median)
        assert np.allclose(sorted(c[:, 0]), [0, 4], atol=0.2)
    m, s, basis = cluster.principal(df, 0.9)
    assert np.allclose(m, x.mean(0)) and np.allclose(s, x.std(0)) and basis.shape == (3, 1)


def test_forests_find_the_outlier(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (400, 2)))] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    for f in (anomaly.isolation_scores, anomaly.cut_scores):
        assert f(df, "id", ["a", "b"]).orderBy(F.desc("score")).first().id == 999
    assert anomaly.score_of_paths(float(anomaly.average_path(256)), 256) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        anomaly.check_threshold(0.4)


def test_samples_depend_on_keys_only(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    h = sampling.hold_out(df, 0.25, "g", "id")
    counts = {r.g: (r.n, r.t) for r in h.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("train").cast("int")).alias("t")).collect()}
    assert counts == {0: (334, 84), 1: (333, 84), 2: (333, 84)}
    one = {r.id for r in sampling.hold_out(df.repartition(7), 0.25, "g", "id").where("train").collect()}
    assert one == {r.id for r in h.where("train").collect()}
    assert 900 < sampling.bootstrap(df, "id").count() < 1100


def test_network_learns_and_is_saved(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 50 - 1, float(i > 50)) for i in range(100)], "id int, x double, t double")
    net, history = network.train(df, ["x"], "t", [8, 2], "softmax", epochs=40, rate=0.1)
    assert history[-1] < 0.3 * history[0]
    network.save(net, df, str(tmp_path / "net"))
    again = network.load(spark.read.parquet(str(tmp_path / "net")))
    x = np.array([[0.3], [-0.4]])
    assert np.allclose(net.forward(x)[-1], again.forward(x)[-1])


def test_network_gradients_are_numeric_gradients():
    r = np.random.default_rng(0)
    net, x, t = network.Network([3, 4, 1], 2), r.normal(size=(5, 3)), r.normal(size=5)
    _, g = net.gradients(x, t, "mse")
    w, b = net.layers[0]
    for i, j in ((0, 0), (2, 3)):
        up, down = w.copy(), w.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        net.layers[0] = (up, b)
        a = net.gradients(x, t, "mse")[0]
        net.layers[0] = (down, b)
        assert (a - net.gradients(x, t, "mse")[0]) / 2e-5 == pytest.approx(g[0][0][i, j], rel=1e-4, abs=1e-6)


def test_causal_attention_ignores_the_future():
    block = sequence.EncoderBlock(4, causal=True)
    x = np.random.default_rng(1).normal(size=(5, 4))
    y = x.copy()
    y[4] += 1
    assert np.allclose(block(x)[:4], block(y)[:4])


def test_vocabulary_order(spark):
    df = spark.createDataFrame([(0, "b a a c"), (1, "c b a")], "doc_id int, text string")
    v = {r.word: (r.n, r.id) for r in T.vocabulary(T.positions(df, "doc_id", F.split("text", " ")), "doc_id").collect()}
    assert v == {"a": (3, 0), "b": (2, 1), "c": (2, 2)}


def test_bleu_of_equal_and_empty(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"]), ([], ["a"])], "p array<string>, r array<string>")
    assert [r[0] for r in df.select(T.bleu(F.col("p"), F.col("r"))).collect()] == [1.0, 0.0]


def test_readers(spark, tmp_path):
    pixels = np.arange(2 * 6, dtype=np.uint8)
    (tmp_path / "img").write_bytes(np.array([2051, 2, 2, 3], ">u4").tobytes() + pixels.tobytes())
    (tmp_path / "lab").write_bytes(np.array([2049, 2], ">u4").tobytes() + bytes([7, 1]))
    img = readers.idx_images(spark, str(tmp_path / "img"), normalize=False).orderBy("id").collect()
    assert [r.pixels[0] for r in img] == [0.0, 6.0] and (img[0].rows, img[0].cols) == (2, 3)
    assert [r.label for r in readers.idx_labels(spark, str(tmp_path / "lab")).orderBy("id").collect()] == [7, 1]
    (tmp_path / "ptb.txt").write_text(" a b \n c \n")
    assert [r.word for r in readers.corpus_words(spark, str(tmp_path / "ptb.txt")).orderBy("pos").collect()] == ["a", "b", "<eos>", "c", "<eos>"]
    (tmp_path / "3_12.txt").write_text("01\n10\n")
    d = readers.digit_bitmaps(spark, str(tmp_path / "3_12.txt")).first()
    assert d.digit == 3 and d.bits == [0, 1, 1, 0]
    (tmp_path / "h.csv").write_text("1,NA\n2,x\n\n")
    assert readers.delimited(spark, str(tmp_path / "h.csv"), "a int, b string").count() == 2
    np.save(tmp_path / "x.npy", np.ones((3, 2)))
    assert readers.numpy_vectors(spark, str(tmp_path / "x.npy")).count() == 3
    (tmp_path / "add.txt").write_text("16+75  _91\n")
    assert tuple(readers.fixed_width_pairs(spark, str(tmp_path / "add.txt")).first()) == ("16+75  ", "_91")


def test_impute_and_encode(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 3.0, None), (3, None, "y")], "id int, v double, c string")
    got = {r.id: r for r in readers.impute_and_encode(df, ["v"], {"c": ["x", "y"]}).collect()}
    assert got[3].v == 0.0 and got[2].c_null == 1 and got[1].c_x == 1 and got[1].c_y == 0


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=20 * i), i % 2, "click", float(i)) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "in"))
    q = windows.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 12
    q = windows.recurrent(stream).writeStream.outputMode("update").format("memory").queryName("s").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    assert {r.user_id: r.steps for r in spark.sql("select * from s").collect()} == {0: 6, 1: 6}


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def events(spark, tmp_path):
    """Two files of six events, read one in a batch."""
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=20 * i), i % 2, "click", float(i)) for i in range(12)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run_to_end(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_windowed_stream(spark, events):
    run_to_end(windows.windowed(events), "complete", "windowed_events")
    assert [(r.n, r.total) for r in spark.sql("select * from windowed_events order by start").collect()] == [(3, 3.0), (3, 12.0), (3, 21.0), (3, 30.0)]


def test_recurrent_stream(spark, events):
    run_to_end(windows.recurrent(events), "update", "recurrent_events")
    got = {(r.user_id, r.steps): r.h for r in spark.sql("select * from recurrent_events").collect()}
    expected = {}
    for user in (0, 1):
        h = 0.0
        for n, v in enumerate(range(user, 12, 2), 1):
            h = np.tanh(0.8 * v / 100 + 0.5 * h)
            if n in (3, 6):
                expected[user, n] = h
    assert got.keys() == expected.keys() and all(np.isclose(got[k], expected[k]) for k in got)
