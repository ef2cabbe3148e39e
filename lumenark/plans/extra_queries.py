"""Predicates, masks, lookups, two-dimensional layers, monitors of training, signal detection, and relational operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.functions import image
from lumenark.functions import vector as V
from lumenark.operators import classify, regression, sampling, series
from lumenark.plans.kit import Query, rounded, table
from lumenark.plans.vector_queries import vectors

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TESTS = {"lt": ("l_quantity < 10", lambda q: q < 10), "le": ("l_quantity <= 10", lambda q: q <= 10), "eq": ("l_quantity = 10", lambda q: q == 10), "ne": ("l_quantity <> 10", lambda q: q != 10), "gt": ("l_quantity > 10", lambda q: q > 10), "ge": ("l_quantity >= 10", lambda q: q >= 10)}


@register("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER ({s}) AS {n}" for n, (s, _) in _TESTS.items()) + ", count(*) AS always FROM lineitem GROUP BY l_returnflag")
def cond_compare(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.count_if(c(F.col("l_quantity"))).alias(n) for n, (_, c) in _TESTS.items()), F.count("*").alias("always"))


@register("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_quantity > 10 AND l_discount <= 0.05 AND l_tax <> 0.02) GROUP BY l_returnflag")
def cond_all(spark, sf_dir):
    conditions = [F.col("l_quantity") > 10, F.col("l_discount") <= 0.05, F.col("l_tax") != 0.02]
    return table(spark, sf_dir, "lineitem").where(reduce(lambda a, b: a & b, conditions)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_quantity > 45 OR l_discount = 0.1 OR l_tax = 0.02) GROUP BY l_returnflag")
def cond_any(spark, sf_dir):
    conditions = [F.col("l_quantity") > 45, F.col("l_discount") == 0.1, F.col("l_tax") == 0.02]
    return table(spark, sf_dir, "lineitem").where(reduce(lambda a, b: a | b, conditions)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS value FROM events")
def mask_put(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("value"))


@register("SELECT conv_id, turn, (k < length(text) % 9)::INTEGER AS valid, k::INTEGER AS k FROM conversations, range(0, 8) t(k)")
def mask_valid_length(spark, sf_dir):
    """Which of 8 places a row's valid length covers."""
    places = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(k.alias("k"), (k < F.length("text") % 9).cast("int").alias("valid")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(places))


_X = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e)"


@register(f"WITH {_X}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM l GROUP BY vec_id) SELECT event_id, user_id, round(n, 6) AS norm, round(n * value, 4) AS dot FROM events JOIN n ON n.vec_id = events.user_id")
def embedding_lookup(spark, sf_dir):
    """Rows by id, then a product with the context value; an equi-join."""
    n = vectors(spark, sf_dir).select("vec_id", F.sqrt(V.dot(F.col("x"), F.col("x"))).alias("n"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return e.join(n, F.col("user_id") == F.col("vec_id")).select("event_id", "user_id", rounded(F.col("n")).alias("norm"), rounded(F.col("n") * F.col("value"), 4).alias("dot"))


@register("SELECT user_id AS id, round(sum(value), 5) AS gradient, count(*) AS n FROM events GROUP BY user_id")
def embedding_scatter_add(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(rounded(F.sum("value"), 5).alias("gradient"), F.count("*").alias("n"))


@register("WITH n AS (SELECT sqrt(sum(value * value)) AS n FROM events) SELECT event_id, round(value * least(1, 5 / (n + 1e-8)), 9) AS g FROM events, n")
def optim_clip_gradient(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    n = e.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return e.join(F.broadcast(n)).select("event_id", rounded(F.col("value") * F.least(F.lit(1.0), 5 / (F.col("n") + 1e-8)), 9).alias("g"))


@register(f"WITH {_X}, z AS (SELECT vec_id, label, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM l WHERE i < 10) SELECT round(-avg(ln(p + 1e-8)), 8) AS loss FROM z WHERE i = label")
def loss_softmax_labels(spark, sf_dir):
    p = V.softmax(F.slice("x", 1, 10))
    return vectors(spark, sf_dir).agg(rounded(-F.avg(F.log(F.get(p, F.col("label")) + 1e-8)), 8).alias("loss"))


@register(f"WITH {_X}, z AS (SELECT vec_id, label, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM l WHERE i < 10) SELECT vec_id, i::INTEGER AS pos, round(p - CASE WHEN i = label THEN 1 ELSE 0 END, 8) + 0.0::DOUBLE AS g FROM z")
def loss_softmax_gradient(spark, sf_dir):
    g = F.zip_with(V.softmax(F.slice("x", 1, 10)), V.one_hot(F.col("label"), 10), lambda p, t: p - t)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(g).alias("pos", "g")).select("vec_id", "pos", rounded(F.col("g"), 8).alias("g"))


@register(f"WITH {_X}, z AS (SELECT vec_id, label, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p, max(v) OVER (PARTITION BY vec_id) = v AS top FROM l WHERE i < 10) SELECT label, count(*) AS n, count(*) FILTER (i = label) AS hits FROM z WHERE top GROUP BY label")
def metric_top_class(spark, sf_dir):
    ten = F.slice("x", 1, 10)
    return vectors(spark, sf_dir).select("label", (F.array_position(ten, F.array_max(ten)) - 1).alias("i")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("label")).alias("hits"))


_C = f"{_X}, c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM l)"


def _cells(spark, sf_dir):
    return image.long_form(vectors(spark, sf_dir), "vec_id", "x", 8)


@register(f"WITH {_C}, k(ky, kx, w) AS (VALUES (0, 0, 0.5), (0, 1, -0.25), (1, 0, 0.125), (1, 1, 1.0)) SELECT vec_id, (y - ky)::INTEGER AS oy, (x - kx)::INTEGER AS ox, round(sum(v * w), 7) + 0.0::DOUBLE AS v FROM c, k WHERE y - ky BETWEEN 0 AND 6 AND x - kx BETWEEN 0 AND 6 GROUP BY ALL")
def layer_conv2d(spark, sf_dir):
    out = image.convolved(image.patches(_cells(spark, sf_dir), "vec_id", 8, 8, 2, 2), "vec_id", [[0.5, -0.25], [0.125, 1.0]])
    return out.select("vec_id", "oy", "ox", rounded(F.col("v"), 7).alias("v"))


@register(f"WITH {_C} SELECT vec_id, (y // 2)::INTEGER AS oy, (x // 2)::INTEGER AS ox, round(max(v), 7) + 0.0::DOUBLE AS largest, round(avg(v), 7) + 0.0::DOUBLE AS mean FROM c GROUP BY vec_id, y // 2, c.x // 2")
def layer_pool2d(spark, sf_dir):
    p = image.patches(_cells(spark, sf_dir), "vec_id", 8, 8, 2, 2, 2).groupBy("vec_id", "oy", "ox")
    return p.agg(rounded(F.max("v"), 7).alias("largest"), rounded(F.avg("v"), 7).alias("mean"))


@register(f"WITH {_C}, t AS (SELECT ky, kx FROM range(0, 3) a(ky), range(0, 3) b(kx)) SELECT vec_id, (y - ky)::INTEGER AS oy, (x - kx)::INTEGER AS ox, ky::INTEGER AS ky, kx::INTEGER AS kx, round(v, 7) + 0.0::DOUBLE AS v FROM c, t WHERE y - ky BETWEEN 0 AND 5 AND x - kx BETWEEN 0 AND 5")
def layer_im2col(spark, sf_dir):
    return image.patches(_cells(spark, sf_dir), "vec_id", 8, 8, 3, 3).select("vec_id", "oy", "ox", "ky", "kx", rounded(F.col("v"), 7).alias("v"))


@register(f"WITH {_C}, t AS (SELECT ky, kx FROM range(0, 3) a(ky), range(0, 3) b(kx)) SELECT vec_id, y::INTEGER AS y, x::INTEGER AS x, round(sum(v), 6) + 0.0::DOUBLE AS v FROM c, t WHERE y - ky BETWEEN 0 AND 5 AND x - kx BETWEEN 0 AND 5 GROUP BY ALL")
def layer_col2im(spark, sf_dir):
    """The adjoint: each cell gets back the sum over the windows it was in."""
    p = image.patches(_cells(spark, sf_dir), "vec_id", 8, 8, 3, 3)
    return p.groupBy("vec_id", (F.col("oy") + F.col("ky")).alias("y"), (F.col("ox") + F.col("kx")).alias("x")).agg(rounded(F.sum("v")).alias("v"))


_H = "h AS (SELECT row_number() OVER (ORDER BY d) - 1 AS epoch, loss FROM (SELECT date_trunc('day', ts) AS d, avg(value) AS loss FROM events GROUP BY 1))"


def _history(spark, sf_dir):
    """One loss for each day, as a training history would have one for each epoch."""
    d = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg("value").alias("loss"))
    return d.select((F.row_number().over(Window.orderBy("d")) - 1).alias("epoch"), "loss")


@register(f"WITH {_H}, b AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best FROM h) SELECT epoch::INTEGER AS epoch, round(loss, 6) AS loss, round(best, 6) AS best, round(100 * (loss / best - 1), 5) + 0.0::DOUBLE AS generalization, (100 * (loss / best - 1) > 5) AS stop FROM b")
def monitor_generalization(spark, sf_dir):
    b = _history(spark, sf_dir).withColumn("best", F.min("loss").over(Window.orderBy("epoch")))
    g = 100 * (F.col("loss") / F.col("best") - 1)
    return b.select("epoch", rounded(F.col("loss")).alias("loss"), rounded(F.col("best")).alias("best"), rounded(g, 5).alias("generalization"), (g > 5).alias("stop"))


@register(f"WITH {_H}, b AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best FROM h), l AS (SELECT *, max(CASE WHEN loss = best THEN epoch END) OVER (ORDER BY epoch) AS last FROM b) SELECT epoch::INTEGER AS epoch, (epoch - last)::INTEGER AS waited, epoch - last > 5 AS stop FROM l")
def monitor_patience(spark, sf_dir):
    w = Window.orderBy("epoch")
    b = _history(spark, sf_dir).withColumn("best", F.min("loss").over(w))
    last = F.max(F.when(F.col("loss") == F.col("best"), F.col("epoch"))).over(w)
    return b.withColumn("waited", F.col("epoch") - last).select("epoch", "waited", (F.col("waited") > 5).alias("stop"))


@register(f"WITH {_H}, b AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best, avg(loss) OVER s AS m, min(loss) OVER s AS lo FROM h WINDOW s AS (ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT epoch::INTEGER AS epoch, round(100 * (loss / best - 1) / nullif(1000 * (m / lo - 1), 0), 6) + 0.0::DOUBLE AS quotient FROM b WHERE epoch >= 4")
def monitor_progress(spark, sf_dir):
    s = Window.orderBy("epoch").rowsBetween(-4, 0)
    b = _history(spark, sf_dir).withColumns({"best": F.min("loss").over(Window.orderBy("epoch")), "m": F.avg("loss").over(s), "lo": F.min("loss").over(s)})
    q = F.try_divide(100 * (F.col("loss") / F.col("best") - 1), 1000 * (F.col("m") / F.col("lo") - 1))
    return b.where("epoch >= 4").select("epoch", rounded(q).alias("quotient"))


@register("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey JOIN nation c ON b.n_nationkey < c.n_nationkey AND b.n_regionkey = c.n_regionkey")
def set_combinations(spark, sf_dir):
    """All threes of a region's nations, in order."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b, c = (n.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias("r")) for k in "abc")
    return a.join(b, "r").where("a < b").join(c, "r").where("b < c").select("a", "b", "c")


@register()
def series_pacf(spark, sf_dir):
    """Partial autocorrelations: ratios of determinants of the first six autocorrelations."""
    e = series.global_row_number(table(spark, sf_dir, "events").select("ts", "event_id", "value"), ["ts", "event_id"])
    r = [1.0, *(x.r for x in series.autocovariance(e, "value", 6).orderBy("k").collect())]
    rows = []
    for k in range(1, len(r)):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        top = m.copy()
        top[:, -1] = r[1 : k + 1]
        rows.append((k, float(np.linalg.det(top) / np.linalg.det(m))))
    return spark.createDataFrame(rows, "k int, pacf double")


@register()
def series_spline_outliers(spark, sf_dir):
    """Values over three deviations off a spline through each user's daily means; one series a group."""

    def flag(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("ts")
        t = (s["ts"] - s["ts"].iloc[0]).dt.total_seconds().to_numpy() / 86400
        days = pd.DataFrame({"d": t.astype(int), "t": t, "v": s["value"]}).groupby("d").mean()
        x, y = days["t"].to_numpy(), days["v"].to_numpy()
        if len(x) < 3:
            return s.iloc[:0][["event_id", "user_id"]].assign(residual=0.0)
        c = regression.cubic_spline(x, y, natural=True)
        i = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(x) - 2)
        d = np.clip(t, x[0], x[-1]) - x[i]
        e = s["value"].to_numpy() - (c[i, 0] + d * (c[i, 1] + d * (c[i, 2] + d * c[i, 3])))
        out = s.assign(residual=e)[np.abs(e - e.mean()) > 3 * e.std()]
        return out[["event_id", "user_id", "residual"]]

    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value").groupBy("user_id").applyInPandas(flag, "event_id long, user_id long, residual double")


@register()
def forest_votes(spark, sf_dir):
    """Five trees on bootstrap samples; the majority of their votes against the labels."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"), "event_type")
    trees = [classify.grow_tree(sampling.bootstrap(e, "event_id", seed), ["value", "hour"], "event_type", depth=2, bins=16) for seed in range(5)]
    votes = e.select("event_type", F.array(*(t.column() for t in trees)).alias("v"))
    best = F.array_max(F.transform("v", lambda x: F.struct(F.size(F.filter("v", lambda y: y == x)).alias("n"), x.alias("l"))))["l"]
    return votes.groupBy("event_type", best.alias("predicted")).agg(F.count("*").alias("n"))


@register("SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
def relation_rollup(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def relation_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def relation_top_by_group(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_extendedprice")


@register("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1000, 3) AS charge, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def relation_pricing(spark, sf_dir):
    d = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.sum("l_quantity"), 2).alias("quantity"), rounded(F.sum(d), 2).alias("revenue"), rounded(F.sum(d * (1 + F.col("l_tax"))) / 1000, 3).alias("charge"), rounded(F.avg("l_discount")).alias("discount"), F.count("*").alias("n"))
