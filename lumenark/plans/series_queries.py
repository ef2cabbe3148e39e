"""Statistics, tests, scalers and time-series operators over events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.operators import series, stats
from lumenark.plans.kit import Query, rounded, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.global_row_number(_events(spark, sf_dir).select("ts", "event_id", "value", "event_type"), ["ts", "event_id"])


_O = "o AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)"


@register("SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round((avg(pow(value, 3)) - 3 * avg(value) * avg(pow(value, 2)) + 2 * pow(avg(value), 3)) / pow(stddev_pop(value), 3), 5) AS skew, round(kurtosis_pop(value), 5) AS kurtosis FROM events GROUP BY event_type")
def agg_moments(spark, sf_dir):
    m = _events(spark, sf_dir).groupBy("event_type").agg(*(c.alias(n) for n, c in stats.moments(F.col("value")).items()))
    return m.select("event_type", "n", *(rounded(F.col(c), 5).alias(c) for c in ("mean", "std", "skew", "kurtosis")))


@register("""WITH m AS (SELECT event_type, count(value)::DOUBLE AS n, (avg(pow(value, 3)) - 3 * avg(value) * avg(pow(value, 2)) + 2 * pow(avg(value), 3)) / pow(stddev_pop(value), 3) AS s, kurtosis_pop(value) AS q FROM events GROUP BY event_type)
SELECT event_type, round(s * s * (n + 1) * (n + 3) / (6 * (n - 2)) + pow(q + 6 / (n + 1), 2) * (n + 1) * (n + 1) * (n + 3) * (n + 5) / (24 * n * (n - 2) * (n - 3)), 3) AS k FROM m""")
def test_normality(spark, sf_dir):
    m = _events(spark, sf_dir).groupBy("event_type").agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("q"))
    return m.select("event_type", rounded(stats.omnibus(F.col("n"), F.col("s"), F.col("q")), 3).alias("k"))


_ACF = f"WITH {_O}, c AS (SELECT rn, value - avg(value) OVER () AS c FROM o), r AS (SELECT k, sum(a.c * b.c) / (SELECT sum(c * c) FROM c) AS r FROM c a, range(1, 7) t(k), c b WHERE b.rn = a.rn + k GROUP BY k)"


@register(f"{_ACF} SELECT k::INTEGER AS k, round(r, 7) + 0.0::DOUBLE AS r FROM r")
def series_acf(spark, sf_dir):
    return series.autocovariance(_ordered(spark, sf_dir), "value", 6).select("k", rounded(F.col("r"), 7).alias("r"))


@register(f"{_ACF} SELECT round(n * (n + 2) * (SELECT sum(r * r / (n - k)) FROM r), 4) AS q FROM (SELECT count(*)::DOUBLE AS n FROM o)")
def test_white_noise(spark, sf_dir):
    o = _ordered(spark, sf_dir)
    n = o.agg(F.count("*").cast("double").alias("n"))
    r = series.autocovariance(o, "value", 6).join(F.broadcast(n))
    return r.groupBy("n").agg(F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("k"))).alias("s")).select(rounded(F.col("n") * (F.col("n") + 2) * F.col("s"), 4).alias("q"))


@register(f"WITH {_O}, f AS (SELECT rn, value > 30 AS f, lag(value > 30) OVER (ORDER BY rn) AS p FROM o) SELECT count(*) FILTER (NOT f) AS n0, count(*) FILTER (f) AS n1, 1 + count(*) FILTER (f <> p) AS runs FROM f")
def test_runs(spark, sf_dir):
    f = _ordered(spark, sf_dir).select("rn", (F.col("value") > 30).cast("int").alias("f"))
    j = series.lagged(f, "f", 1, name="p")
    return j.agg(F.sum((F.col("f") == 0).cast("long")).alias("n0"), F.sum(F.col("f").cast("long")).alias("n1"), (1 + F.sum(F.coalesce((F.col("f") != F.col("p")).cast("long"), F.lit(0)))).alias("runs"))


@register("WITH r AS (SELECT event_type = 'click' AS pos, row_number() OVER (ORDER BY value, event_type = 'click', event_id) AS r FROM events) SELECT round((sum(r) FILTER (pos) - p * (p + 1) / 2) / (p * (n - p)), 8) AS auc FROM r, (SELECT count(*) FILTER (event_type = 'click')::DOUBLE AS p, count(*)::DOUBLE AS n FROM events) GROUP BY p, n")
def test_auc(spark, sf_dir):
    e = _events(spark, sf_dir).select("value", (F.col("event_type") == "click").cast("int").alias("pos"), "event_id")
    r = series.global_row_number(e, ["value", "pos", "event_id"])
    a = r.agg(F.sum(F.when(F.col("pos") == 1, F.col("rn"))).alias("s"), F.sum("pos").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    return a.select(rounded((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 8).alias("auc"))


@register(f"WITH {_O} SELECT event_id, round(value - lag(value, 3) OVER (ORDER BY rn), 6) + 0.0::DOUBLE AS d FROM o")
def scale_diff(spark, sf_dir):
    return series.lagged(_ordered(spark, sf_dir), "value", 3).select("event_id", rounded(F.col("value") - F.col("value_lag3")).alias("d"))


_BY_USER = "(SELECT user_id, ts, value, value - lag(value) OVER w AS dy, value * 0.5 + event_id % 7 - lag(value * 0.5 + event_id % 7) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"


def _diffs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    t = F.col("value") * 0.5 + F.col("event_id") % 7
    e = _events(spark, sf_dir).withColumn("t", t)
    return e.select("user_id", (F.col("value") - F.lag("value").over(w)).alias("dy"), (F.col("t") - F.lag("t").over(w)).alias("dt")).where("dy is not null")


@register(f"SELECT user_id, round(avg(CASE WHEN sign(dy) = sign(dt) THEN 1.0::DOUBLE ELSE 0 END), 8) AS accuracy FROM {_BY_USER} WHERE dy IS NOT NULL GROUP BY user_id")
def metric_trend_accuracy(spark, sf_dir):
    return _diffs(spark, sf_dir).groupBy("user_id").agg(rounded(F.avg((F.signum("dy") == F.signum("dt")).cast("double")), 8).alias("accuracy"))


@register(f"SELECT user_id, round(avg((dy - dt) * (dy - dt)) / 2, 5) AS loss FROM {_BY_USER} WHERE dy IS NOT NULL GROUP BY user_id")
def loss_difference(spark, sf_dir):
    return _diffs(spark, sf_dir).groupBy("user_id").agg(rounded(F.avg((F.col("dy") - F.col("dt")) * (F.col("dy") - F.col("dt"))) / 2, 5).alias("loss"))


_SEG = """p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p, value > 30 AS f FROM events),
g AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM p WHERE f),
s AS (SELECT user_id, (min(p) - 1)::INTEGER AS start, (max(p) - 1)::INTEGER AS "end", count(*) AS length FROM g GROUP BY user_id, g)"""


def _segments(spark, sf_dir):
    return series.runs(_events(spark, sf_dir), ["user_id"], ["ts"], F.col("value") > 30)


@register(f"WITH {_SEG} SELECT * FROM s WHERE length > 2")
def series_segments(spark, sf_dir):
    return _segments(spark, sf_dir).where("length > 2")


@register(f"WITH {_SEG} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1")
def series_longest_segment(spark, sf_dir):
    return series.longest_run(_segments(spark, sf_dir), ["user_id"])


@register("""WITH w AS (SELECT user_id, row_number() OVER v - 1 AS p, value AS x0, lead(value, 1) OVER v AS x1, lead(value, 2) OVER v AS x2, lead(value, 3) OVER v AS y0, lead(value, 4) OVER v AS y1 FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, p::INTEGER AS p, round(x0 + 2 * x1 + 3 * x2, 6) AS x, round(y0 - y1, 6) + 0.0::DOUBLE AS y FROM w WHERE y1 IS NOT NULL""")
def series_windows(spark, sf_dir):
    w = series.windows(_events(spark, sf_dir), ["user_id"], ["ts"], "value", 3, 2)
    at = lambda c, i: F.get(c, F.lit(i))
    return w.select("user_id", "p", rounded(at("x", 0) + 2 * at("x", 1) + 3 * at("x", 2)).alias("x"), rounded(at("y", 0) - at("y", 1)).alias("y"))


@register(f"WITH {_O} SELECT event_id, round(value, 6) AS y, round(0.4 * lag(value, 1) OVER w + 0.3 * lag(value, 2) OVER w + 0.2 * lag(value, 3) OVER w + 0.1 * lag(value, 4) OVER w, 6) AS ar FROM o WINDOW w AS (ORDER BY rn)")
def series_autoregression(spark, sf_dir):
    o = _ordered(spark, sf_dir).select("event_id", "rn", "value")
    ahead = o.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "rn", "value").select((F.col("rn") + F.col("k")).alias("rn"), (F.col("value") * (0.5 - 0.1 * F.col("k"))).alias("part"))
    ar = ahead.groupBy("rn").agg(F.sum("part").alias("ar"), F.count("*").alias("c"))
    return o.join(ar, "rn", "left").select("event_id", rounded(F.col("value")).alias("y"), rounded(F.when(F.col("c") == 4, F.col("ar"))).alias("ar"))


def _scaler(kind: str, sql: str):
    def query(spark, sf_dir):
        return stats.scaled(_events(spark, sf_dir).select("event_id", "value"), "value", kind).select("event_id", rounded(F.col("z"), 7).alias("z"))

    QUERIES[f"scale_{kind}"] = query
    SQL[f"scale_{kind}"] = f"SELECT event_id, round({sql}, 7) + 0.0::DOUBLE AS z FROM events, s"


_scaler("minmax", "(value - a) / nullif(b, 0)")
_scaler("standard", "(value - a) / nullif(b, 0)")
_scaler("robust", "(value - a) / nullif(b, 0)")
_scaler("median", "(value - a) / nullif(b, 0)")
_STATS = {"minmax": "SELECT min(value) AS a, max(value) - min(value) AS b FROM events", "standard": "SELECT avg(value) AS a, stddev_pop(value) AS b FROM events", "robust": "SELECT quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS b FROM events", "median": "SELECT any_value(m) AS a, quantile_cont(abs(value - m), 0.5) AS b FROM events, (SELECT quantile_cont(value, 0.5) AS m FROM events)"}
for _k, _s in _STATS.items():
    SQL[f"scale_{_k}"] = f"WITH s AS ({_s}) {SQL[f'scale_{_k}']}"


@register("WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS b FROM events), z AS (SELECT event_id, (value - a) / b AS z FROM events, m), r AS (SELECT min(z) AS lo, max(z) - min(z) AS w FROM z) SELECT event_id, round((z - lo) / w, 7) + 0.0::DOUBLE AS z FROM z, r")
def scale_chain(spark, sf_dir):
    one = stats.scaled(_events(spark, sf_dir).select("event_id", "value"), "value", "standard", "s")
    return stats.scaled(one, "s", "minmax").select("event_id", rounded(F.col("z"), 7).alias("z"))


@register("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def agg_quantiles(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(*(rounded(F.percentile("value", F.lit(q / 100))).alias(f"q{q}") for q in (10, 50, 90)))


@register("SELECT event_type, v[len(v) // 2 + 1] AS upper, v[(len(v) + 1) // 2] AS lower FROM (SELECT event_type, list_sort(list_distinct(list(value))) AS v FROM events GROUP BY event_type)")
def agg_existing_median(spark, sf_dir):
    """The middle of the distinct values, the upper and the lower one of an even count."""
    d = _events(spark, sf_dir).select("event_type", "value").distinct()
    w = Window.partitionBy("event_type")
    r = d.withColumns({"r": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    return r.groupBy("event_type").agg(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("upper"), F.max(F.when(F.col("r") == F.floor((F.col("n") + 1) / 2), F.col("value"))).alias("lower"))


@register("SELECT round(quantile_cont(pow(2.0, -value / 10.24), 0.05), 9) AS threshold FROM events")
def anomaly_quantile_threshold(spark, sf_dir):
    return _events(spark, sf_dir).agg(rounded(F.percentile(F.pow(F.lit(2.0), -F.col("value") / 10.24), F.lit(0.05)), 9).alias("threshold"))


@register("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), k AS (SELECT count(*) FILTER (value BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) >= 0.85 * count(*) AS cut FROM events, q)
SELECT event_id FROM events, q, k WHERE NOT cut OR value BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def filter_interquartile(spark, sf_dir):
    """Values outside the quartiles by over half their distance go, unless under 85 of 100 would remain."""
    e = _events(spark, sf_dir).select("event_id", "value")
    a, b = (F.lit(x).cast("double") for x in stats.quantiles(e, "value", [0.25, 0.75]))
    inside = F.col("value").between(a - 0.5 * (b - a), b + 0.5 * (b - a))
    k = e.agg((100 * F.count_if(inside) >= 85 * F.count("*")).alias("cut"))
    return e.join(F.broadcast(k)).where(~F.col("cut") | inside).select("event_id")


@register("WITH r AS (SELECT ln(value) AS x, row_number() OVER (ORDER BY value, event_id) AS r, count(*) OVER () AS n FROM events WHERE value > 0), y AS (SELECT x, ln(-ln(1 - r / (n + 1.0::DOUBLE))) AS y FROM r) SELECT round(regr_slope(y, x), 7) AS beta, round(exp(-regr_intercept(y, x) / regr_slope(y, x)), 5) AS eta FROM y")
def weibull_ols(spark, sf_dir):
    e = series.global_row_number(_events(spark, sf_dir).where("value > 0").select("value", "event_id"), ["value", "event_id"])
    n = e.agg(F.count("*").alias("n"))
    y = e.join(F.broadcast(n)).select(F.log("value").alias("x"), F.log(-F.log(1 - F.col("rn") / (F.col("n") + 1.0))).alias("y"))
    return y.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).select(rounded(F.col("b"), 7).alias("beta"), rounded(F.exp(-F.col("a") / F.col("b")), 5).alias("eta"))


@register("SELECT round(sum(ln(0.9::DOUBLE / 45) + (0.9 - 1) * ln(value / 45) - pow(value / 45, 0.9)), 3) AS log_likelihood, round(sum(1 / 0.9::DOUBLE + ln(value / 45) - pow(value / 45, 0.9) * ln(value / 45)), 3) AS d_beta, round(sum(0.9::DOUBLE / 45 * (pow(value / 45, 0.9) - 1)), 5) AS d_eta FROM events WHERE value > 0")
def weibull_likelihood(spark, sf_dir):
    u = F.col("value") / 45
    p = F.pow(u, F.lit(0.9))
    e = _events(spark, sf_dir).where("value > 0")
    return e.agg(rounded(F.sum(F.log(F.lit(0.9 / 45)) + (0.9 - 1) * F.log(u) - p), 3).alias("log_likelihood"), rounded(F.sum(1 / 0.9 + F.log(u) - p * F.log(u)), 3).alias("d_beta"), rounded(F.sum(0.9 / 45 * (p - 1)), 5).alias("d_eta"))


@register("WITH b AS (SELECT order_id, f FROM (SELECT o_orderkey AS order_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), LATERAL (SELECT least(i // (n // 5), 4)::INTEGER AS f)) SELECT f AS fold, count(*) AS n, min(order_id) AS first, max(order_id) AS last FROM b GROUP BY f")
def split_folds(spark, sf_dir):
    """Five contiguous folds, the last with what is over."""
    o = series.global_row_number(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    n = o.agg(F.count("*").alias("n"))
    return o.join(F.broadcast(n)).select("o_orderkey", F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / 5)), F.lit(4)).cast("int").alias("fold")).groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@register("WITH b AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 256 AS batch FROM orders) SELECT batch, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM b GROUP BY batch")
def split_batches(spark, sf_dir):
    o = series.global_row_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return o.select(F.floor((F.col("rn") - 1) / 256).alias("batch"), "o_totalprice").groupBy("batch").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@register("WITH b AS (SELECT date_trunc('day', ts) AS day, user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS users, sum(n)::BIGINT AS n, round(sum(v), 4) AS total FROM b GROUP BY 1")
def window_tumbling(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("d"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return e.groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("users"), F.sum("n").alias("n"), rounded(F.sum("v"), 4).alias("total"))
