"""Regression, classification, trees and clustering over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import vector as V
from lumenark.operators import classify, cluster, regression, stats
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


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _row(spark: SparkSession, values: dict[str, float], digits: int = 5) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), digits) + 0.0 for v in values.values())], ", ".join(f"{k} double" for k in values))




def _features(*names: str):
    return {n: F.col(n) for n in names}


@register("""SELECT l_returnflag AS g, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
 round(sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) AS sigma FROM lineitem GROUP BY l_returnflag""")
def regression_simple(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    s = _lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("g")).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("n"))
    return s.select("g", rounded(F.col("b"), 5).alias("slope"), rounded(F.col("a"), 3).alias("intercept"), rounded(F.col("r"), 8).alias("r2"), rounded(F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)), 3).alias("sigma"))


@register("""WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_tax, l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1, covar_pop(l_tax, l_extendedprice) AS s2, var_pop(l_extendedprice) AS syy, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, count(*)::DOUBLE AS n FROM lineitem),
b AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT *, n * (syy - b1 * s1 - b2 * s2) AS rss FROM b)
SELECT round(my - b1 * m1 - b2 * m2, 2) AS b0, round(b1, 4) AS b1, round(b2, 1) AS b2, round(1 - rss / (n * syy), 8) AS r2, round((n * syy - rss) / 2 / (rss / (n - 3)) / 100, 1) AS f, round((4 + n - 3 + n * ln(2 * pi() * rss / (n - 3))) / 1000, 3) AS aic FROM r""")
def regression_multiple(spark, sf_dir):
    fit = regression.fit_linear(_lines(spark, sf_dir), _features("l_quantity", "l_tax"), F.col("l_extendedprice"))
    return spark.createDataFrame([tuple(float(v) for v in (round(fit.beta[0], 2), round(fit.beta[1], 4), round(fit.beta[2], 1), round(fit.r2, 8), round(fit.f / 100, 1), round(fit.aic / 1000, 3)))], "b0 double, b1 double, b2 double, r2 double, f double, aic double")


@register()
def regression_inference(spark, sf_dir):
    """Coefficients with standard errors, t and p values, of price on quantity, tax and discount."""
    fit = regression.fit_linear(_lines(spark, sf_dir), _features("l_quantity", "l_tax", "l_discount"), F.col("l_extendedprice"))
    rows = [(n, float(b), float(s), float(t), float(p)) for n, b, s, t, p in zip(["", *fit.names], fit.beta, fit.std, fit.t, fit.p_values, strict=True)]
    return spark.createDataFrame(rows, "name string, beta double, std double, t double, p double")


@register("SELECT l_returnflag AS g, count(*)::DOUBLE AS n, round(sum(l_quantity), 4) AS s1, round(sum(l_quantity * l_quantity), 4) AS s11, round(sum(l_quantity * l_tax), 4) AS s12, round(sum(l_quantity * l_extendedprice) / 1e6, 4) AS s1y, round(sum(l_extendedprice * l_extendedprice) / 1e9, 4) AS syy FROM lineitem GROUP BY l_returnflag")
def regression_gram(spark, sf_dir):
    g = regression.grams(_lines(spark, sf_dir), _features("l_quantity", "l_tax"), F.col("l_extendedprice"), by="l_returnflag")
    rows = [(k, m.m[0, 0], round(m.m[0, 1], 4), round(m.m[1, 1], 4), round(m.m[1, 2], 4), round(m.m[1, 3] / 1e6, 4), round(m.m[3, 3] / 1e9, 4)) for k, m in g.items()]
    return spark.createDataFrame([(k, *map(float, v)) for k, *v in rows], "g string, n double, s1 double, s11 double, s12 double, s1y double, syy double")


@register("SELECT round(1 / (1 - pow(corr(l_quantity, l_tax), 2)), 8) AS vif FROM lineitem")
def regression_inflation(spark, sf_dir):
    g = regression.grams(_lines(spark, sf_dir), _features("l_quantity", "l_tax"), F.col("l_extendedprice"))[None]
    return _row(spark, {"vif": regression.inflation(g)[0]}, 8)


def _selection(name: str, f):
    def query(spark, sf_dir):
        g = regression.grams(_lines(spark, sf_dir).withColumn("q2", F.col("l_quantity") * F.col("l_quantity")), _features("l_quantity", "l_tax", "l_discount", "q2"), F.col("l_extendedprice"))[None]
        return spark.createDataFrame([(len(x.names), ",".join(sorted(x.names)), float(x.rss), float(x.bic)) for x in f(g)], "size int, names string, rss double, bic double")

    QUERIES[name] = query


_selection("regression_best_subsets", regression.best_subsets)
_selection("regression_forward", regression.forward)
_selection("regression_backward", regression.backward)


@register()
def regression_cross_validation(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(5)))
    best, errors = regression.cross_validated(regression.grams(d, _features("l_quantity", "l_tax", "l_discount"), F.col("l_extendedprice"), by="fold"))
    return spark.createDataFrame([(i + 1, float(e), i + 1 == best) for i, e in enumerate(errors)], "size int, mse double, best boolean")


@register("""WITH b AS (SELECT event_id, value AS x, CASE WHEN value > 10 THEN pow(value - 10, 3) ELSE 0 END AS a, CASE WHEN value > 50 THEN pow(value - 50, 3) ELSE 0 END AS b, CASE WHEN value > 100 THEN pow(value - 100, 3) ELSE 0 END AS c, CASE WHEN value > 200 THEN pow(value - 200, 3) ELSE 0 END AS d FROM events)
SELECT event_id, x AS h1, round(190 * ((a - d) / 190 - (c - d) / 100) / 1e3, 6) + 0.0::DOUBLE AS h2, round(150 * ((b - d) / 150 - (c - d) / 100) / 1e3, 6) + 0.0::DOUBLE AS h3 FROM b""")
def basis_natural_cubic(spark, sf_dir):
    h = regression.natural_cubic(F.col("value"), [10.0, 50.0, 100.0, 200.0])
    return table(spark, sf_dir, "events").select("event_id", h[0].alias("h1"), rounded(h[1] / 1e3).alias("h2"), rounded(h[2] / 1e3).alias("h3"))


@register()
def regression_logistic(spark, sf_dir):
    """Clicks by value and hour, with the ridge penalty and Wald errors."""
    e = table(spark, sf_dir, "events").select((F.col("value") / 50 - 1).alias("x"), (F.hour("ts") / 24.0).alias("h"), (F.col("event_type") == "click").cast("double").alias("t"))
    theta, std = regression.fit_logistic(e, _features("x", "h"), F.col("t"))
    return spark.createDataFrame([(n, float(a), float(s), float(a / s)) for n, a, s in zip(("", "x", "h"), theta, std, strict=True)], "name string, theta double, std double, z double")


@register()
def weibull_mle(spark, sf_dir):
    b, eta = regression.fit_weibull(table(spark, sf_dir, "events"), "value")
    return _row(spark, {"beta": b, "eta": eta})


@register("WITH s AS (SELECT corr(t.x, t.y) AS r FROM (SELECT value AS x, user_id AS y FROM events) t), k AS (SELECT user_id, exp(-0.5 * pow((value - 50) / 10, 2)) AS w, value FROM events) SELECT user_id, round(sum(w * value) / sum(w), 6) AS y FROM k GROUP BY user_id HAVING sum(w) > 1e-12")
def regression_kernel(spark, sf_dir):
    """Gaussian kernel means of each user's values about 50."""
    w = F.exp(-0.5 * F.pow((F.col("value") - 50) / 10, F.lit(2)))
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(w * F.col("value")).alias("a"), F.sum(w).alias("w"))
    return k.where("w > 1e-12").select("user_id", rounded(F.col("a") / F.col("w")).alias("y"))


_NB = """c AS (SELECT l_returnflag AS label, count(*)::DOUBLE AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1),
k AS (SELECT label, n, m, s, ln((n + 1) / (sum(n) OVER () + count(*) OVER ())) AS prior FROM c),
v AS (SELECT l_returnflag AS label, l_linestatus AS v, count(*)::DOUBLE AS f FROM lineitem GROUP BY 1, 2),
d AS (SELECT k.label, x.v, ln((coalesce(f, 0) + 1) / (n + 2)) AS p FROM k CROSS JOIN (SELECT DISTINCT l_linestatus AS v FROM lineitem) x LEFT JOIN v ON v.label = k.label AND v.v = x.v)"""


def _bayes(spark, sf_dir):
    """Class rows (label, prior, m, s, by) with the log probabilities of both line states, Laplace smoothed."""
    c = _lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").cast("double").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"), *(F.sum((F.col("l_linestatus") == v).cast("double")).alias(f"f{v}") for v in "FO"))
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return c.join(F.broadcast(t)).select("label", F.log((F.col("n") + 1) / (F.col("t") + F.col("k"))).alias("prior"), "m", "s", *(F.log((F.col(f"f{v}") + 1) / (F.col("n") + 2)).alias(f"p{v}") for v in "FO"))


@register(f"WITH {_NB} SELECT k.label, round(prior, 8) + 0.0::DOUBLE AS prior, round(m, 6) AS m, round(s, 6) AS s, round((SELECT p FROM d WHERE d.label = k.label AND v = 'F'), 8) + 0.0::DOUBLE AS p_f, round((SELECT p FROM d WHERE d.label = k.label AND v = 'O'), 8) + 0.0::DOUBLE AS p_o FROM k")
def bayes_train(spark, sf_dir):
    return _bayes(spark, sf_dir).select("label", rounded(F.col("prior"), 8).alias("prior"), rounded(F.col("m")).alias("m"), rounded(F.col("s")).alias("s"), rounded(F.col("pF"), 8).alias("p_f"), rounded(F.col("pO"), 8).alias("p_o"))


@register(f"""WITH {_NB}, x AS (SELECT l_quantity AS q, l_linestatus AS v, count(*) AS c FROM lineitem GROUP BY 1, 2),
s AS (SELECT q, x.v, c, k.label, prior + d.p - pow(q - m, 2) / (2 * s * s) - ln(s) AS score FROM x, k, d WHERE d.label = k.label AND d.v = x.v)
SELECT q, v, arg_max(label, score) AS label, any_value(c) AS c FROM s GROUP BY q, v""")
def bayes_predict(spark, sf_dir):
    m = _bayes(spark, sf_dir).agg(F.collect_list(F.struct("*")).alias("ms"))
    x = _lines(spark, sf_dir).groupBy(F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("v")).agg(F.count("*").alias("c"))

    def score(k):
        return k["prior"] + F.when(F.col("v") == "F", k["pF"]).otherwise(k["pO"]) - F.pow(F.col("q") - k["m"], F.lit(2)) / (2 * k["s"] * k["s"]) - F.log(k["s"])

    return x.join(F.broadcast(m)).select("q", "v", F.array_max(F.transform("ms", lambda k: F.struct(score(k).alias("s"), k["label"].alias("l"))))["l"].alias("label"), "c")




@register("""WITH t AS (SELECT var_pop(l_quantity) * count(*) / (count(*) - 3) AS a, var_pop(l_tax) * count(*) / (count(*) - 3) AS b, covar_pop(l_quantity, l_tax) * count(*) / (count(*) - 3) AS h, count(*)::DOUBLE AS all_n FROM lineitem),
s AS (SELECT l_returnflag AS c, count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_tax) AS m2 FROM lineitem GROUP BY 1)
SELECT c AS label, round(avg(ln(n / all_n) - 0.5 * (b * pow(l_quantity - m1, 2) - 2 * h * (l_quantity - m1) * (l_tax - m2) + a * pow(l_tax - m2, 2)) / (a * b - h * h)), 6) + 0.0::DOUBLE AS score FROM lineitem, s, t GROUP BY c""")
def discriminant_linear(spark, sf_dir):
    d = _lines(spark, sf_dir)
    scores = classify.discriminant(d, ["l_quantity", "l_tax"], "l_returnflag")
    return d.agg(F.array(*(F.struct(F.lit(k).alias("label"), rounded(F.avg(c)).alias("score")) for k, c in scores.items())).alias("r")).select(F.inline("r"))


@register("""WITH s AS (SELECT l_returnflag AS c, count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_tax) AS m2, var_samp(l_quantity) AS a, var_samp(l_tax) AS b, covar_samp(l_quantity, l_tax) AS h FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS all_n FROM s)
SELECT c AS label, round(avg(ln(n / all_n) - 0.5 * ln(a * b - h * h) - 0.5 * (b * pow(l_quantity - m1, 2) - 2 * h * (l_quantity - m1) * (l_tax - m2) + a * pow(l_tax - m2, 2)) / (a * b - h * h)), 6) + 0.0::DOUBLE AS score FROM lineitem, s, t GROUP BY c""")
def discriminant_quadratic(spark, sf_dir):
    d = _lines(spark, sf_dir)
    scores = classify.discriminant(d, ["l_quantity", "l_tax"], "l_returnflag", quadratic=True)
    return d.agg(F.array(*(F.struct(F.lit(k).alias("label"), rounded(F.avg(c)).alias("score")) for k, c in scores.items())).alias("r")).select(F.inline("r"))


@register("WITH c AS (SELECT event_type AS g, user_id, count(*)::DOUBLE AS n FROM events GROUP BY ALL) SELECT g, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 7) AS entropy, round(1 - sum(n * n) / (sum(n) * sum(n)), 7) AS gini FROM c GROUP BY g")
def tree_impurity(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), "user_id").agg(F.count("*").cast("double").alias("n"))
    return stats.entropy(c, ["g"]).select("g", rounded(F.col("entropy"), 7).alias("entropy"), rounded(F.col("gini"), 7).alias("gini"))


_LONG = "x AS (SELECT l_returnflag AS label, 'l_quantity' AS feature, l_quantity AS value, l_extendedprice AS y FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount, l_extendedprice FROM lineitem)"
_CUTS = "u AS (SELECT DISTINCT feature, value FROM x), k AS (SELECT feature, value AS v, (value + lead(value) OVER (PARTITION BY feature ORDER BY value)) / 2 AS cut FROM u)"


@register(f"""WITH {_LONG}, {_CUTS}, h AS (SELECT feature, value, label, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
s AS (SELECT k.feature, k.cut, h.value <= k.v AS side, label, sum(n) AS n FROM k JOIN h USING (feature) WHERE cut IS NOT NULL GROUP BY ALL),
i AS (SELECT feature, cut, side, sum(n) AS t, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS e, sum(n) - sum(n * n) / sum(n) AS g FROM s GROUP BY ALL)
SELECT feature, round(cut, 6) AS cut, round(sum(e) / sum(t), 7) AS entropy, round(sum(g) / sum(t), 7) AS gini FROM i GROUP BY feature, i.cut""")
def tree_class_splits(spark, sf_dir):
    h = classify.histogram(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_returnflag")
    return classify.class_splits(h).select("feature", rounded(F.col("cut")).alias("cut"), rounded(F.col("entropy"), 7).alias("entropy"), rounded(F.col("gini"), 7).alias("gini"))


@register(f"""WITH {_LONG}, {_CUTS}, h AS (SELECT feature, value, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM x GROUP BY ALL),
s AS (SELECT k.feature, k.cut, h.value <= k.v AS side, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM k JOIN h USING (feature) WHERE cut IS NOT NULL GROUP BY ALL)
SELECT feature, round(cut, 6) AS cut, round(sum(q - s * s / n) / 1e9, 5) AS rss FROM s GROUP BY feature, s.cut""")
def tree_variance_splits(spark, sf_dir):
    return classify.variance_splits(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice").select("feature", rounded(F.col("cut")).alias("cut"), rounded(F.col("rss") / 1e9, 5).alias("rss"))


@register()
def tree_predict(spark, sf_dir):
    """A grown classification tree's votes against the labels, over all rows."""
    e = table(spark, sf_dir, "events").select("value", F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double").alias("user_id"), "event_type")
    tree = classify.grow_tree(e, ["value", "hour", "user_id"], "event_type", depth=3)
    return e.groupBy("event_type", tree.column().alias("predicted")).agg(F.count("*").alias("n"))


_C = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e)"
_STEP0 = f"{_C}, c0 AS (SELECT vec_id AS cid, i, v AS c FROM l WHERE vec_id < 8), d0 AS (SELECT vec_id, cid, sum((v - c) * (v - c)) AS d FROM l JOIN c0 USING (i) GROUP BY ALL), a0 AS (SELECT vec_id, cid, d FROM d0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1)"
_STEP1 = f"{_STEP0}, c1 AS (SELECT cid, i, avg(v) AS c FROM a0 JOIN l USING (vec_id) GROUP BY cid, i), d1 AS (SELECT vec_id, cid, sum((v - c) * (v - c)) AS d FROM l JOIN c1 USING (i) GROUP BY ALL), a1 AS (SELECT vec_id, cid, d FROM d1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1)"


def _start(df: DataFrame, k: int = 8) -> DataFrame:
    """The first k vectors as centres, as the query's contract has it."""
    return df.where(F.col("vec_id") < k).select(F.col("vec_id").cast("int").alias("cid"), F.col("x").alias("c"))


@register(f"WITH {_STEP0} SELECT vec_id, cid::INTEGER AS cid, round(d, 6) + 0.0::DOUBLE AS d FROM a0")
def kmeans_assign(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return cluster.assigned(df, _start(df)).select("vec_id", "cid", rounded(F.col("d")).alias("d"))


@register(f"WITH {_STEP1} SELECT vec_id, cid::INTEGER AS cid, round(d, 6) + 0.0::DOUBLE AS d FROM a1")
def kmeans_step(spark, sf_dir):
    df = vectors(spark, sf_dir)
    centres = cluster.means(cluster.assigned(df, _start(df)))
    return cluster.assigned(df, centres).select("vec_id", "cid", rounded(F.col("d")).alias("d"))


@register(f"WITH {_STEP1} SELECT cid::INTEGER AS cid, count(*) AS n, round(sum(d), 6) AS error FROM a1 GROUP BY cid")
def kmeans_error(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return cluster.assigned(df, cluster.means(cluster.assigned(df, _start(df)))).groupBy("cid").agg(F.count("*").alias("n"), rounded(F.sum("d")).alias("error"))


@register(f"WITH {_C}, c0 AS (SELECT vec_id AS cid, i, v AS c FROM l WHERE vec_id < 8), d0 AS (SELECT vec_id, cid, sum(abs(v - c)) AS d FROM l JOIN c0 USING (i) GROUP BY ALL), a0 AS (SELECT vec_id, cid FROM d0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1) SELECT cid::INTEGER AS cid, i::INTEGER AS i, round(quantile_cont(v, 0.5), 7) + 0.0::DOUBLE AS m FROM a0 JOIN l USING (vec_id) GROUP BY cid, l.i")
def kmedians_step(spark, sf_dir):
    df = vectors(spark, sf_dir)
    m = cluster.medians(cluster.assigned(df, _start(df), V.manhattan))
    return m.select("cid", F.posexplode("c").alias("i", "m")).select("cid", "i", rounded(F.col("m"), 7).alias("m"))


@register()
def kmeans_fit(spark, sf_dir):
    """Lloyd's iteration to rest from the first vectors; (k, error)."""
    df = vectors(spark, sf_dir)
    start = np.array([r.c for r in _start(df).orderBy("cid").collect()])
    centres, error = cluster.lloyd(df, start)
    return spark.createDataFrame([(len(centres), float(error))], "k int, error double")


_GMM = "p AS (SELECT value, 0.4 * exp(-pow((value - 20) / 15, 2) / 2) / 15 AS a, 0.6 * exp(-pow((value - 90) / 60, 2) / 2) / 60 AS b FROM events), w AS (SELECT value, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS w FROM p), u AS (SELECT value, 0 AS k, w FROM w UNION ALL SELECT value, 1, 1 - w FROM w)"


@register(f"WITH {_GMM} SELECT k::INTEGER AS k, round(sum(w) / (SELECT count(*) FROM events), 6) AS weight, round(sum(w * value) / sum(w), 5) AS mu, round(sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2), 3) AS variance FROM u GROUP BY k")
def gmm_step(spark, sf_dir):
    """One EM step of two components: both responsibilities of a row are made in place, their sums in one aggregate."""
    v = F.col("value")
    a, b = (w * F.exp(-F.pow((v - m) / s, F.lit(2)) / 2) / s for w, m, s in ((0.4, 20.0, 15.0), (0.6, 90.0, 60.0)))
    w = F.coalesce(F.try_divide(a, a + b), F.lit(0.5))
    e = table(spark, sf_dir, "events").select(v, F.inline(F.array(F.struct(F.lit(0).alias("k"), w.alias("w")), F.struct(F.lit(1).alias("k"), (1 - w).alias("w")))))
    s = e.groupBy("k").agg(F.sum("w").alias("s"), F.sum(F.col("w") * v).alias("m"), F.sum(F.col("w") * v * v).alias("q"))
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select("k", rounded(F.col("s") / F.col("n")).alias("weight"), rounded(F.col("m") / F.col("s"), 5).alias("mu"), rounded(F.col("q") / F.col("s") - F.pow(F.col("m") / F.col("s"), F.lit(2)), 3).alias("variance"))


@register()
def pca_project(spark, sf_dir):
    """The share of variance in the kept principal components, and each vector's place on the first."""
    df = vectors(spark, sf_dir)
    m, s, basis = cluster.principal(df, 0.9)
    first = [float(v) for v in basis[:, 0] / s]
    shift = float(-(m / s) @ basis[:, 0])
    return df.select("vec_id", F.lit(basis.shape[1]).alias("kept"), rounded(V.dot(F.col("x"), F.array(*map(F.lit, first))) + shift).alias("first"))
