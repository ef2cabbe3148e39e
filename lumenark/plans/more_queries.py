"""Attention variants, contrastive and variational losses, data preparation, and pieces of classic learners."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.functions import scalar as S
from lumenark.functions import vector as V
from lumenark.operators import series
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


_X = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e), r AS (SELECT vec_id, i // 8 AS t, i % 8 AS j, v FROM l)"


@register(f"""WITH {_X}, s AS (SELECT a.vec_id, a.t AS q, b.t AS k, sum(0.5 * tanh(0.7 * a.v + 0.3 * b.v)) AS s FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.j = b.j GROUP BY ALL),
p AS (SELECT vec_id, q, k, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id, q) AS p FROM s)
SELECT p.vec_id, (q * 8 + j)::INTEGER AS pos, round(sum(p * v), 7) + 0.0::DOUBLE AS y FROM p JOIN r ON r.vec_id = p.vec_id AND r.t = p.k GROUP BY p.vec_id, q, j""")
def attention_additive(spark, sf_dir):
    """Scores by a tanh of query and key, one weight a place."""
    rows = V.rows_of(F.col("x"), 8)

    def attend(r):
        def one(a):
            scores = F.transform(r, lambda b: V.total(F.zip_with(a, b, lambda u, v: 0.5 * F.tanh(0.7 * u + 0.3 * v))))
            return V.let(V.softmax(scores), lambda w: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: V.total(F.zip_with(w, r, lambda p, b: p * F.get(b, j)))))

        return F.flatten(F.transform(r, one))

    return vectors(spark, sf_dir).select("vec_id", F.posexplode(V.let(rows, attend)).alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 7).alias("y"))


@register(f"WITH {_X}, s AS (SELECT vec_id, t, tanh(sum(v * (j + 1) / 10.0::DOUBLE)) AS s FROM r GROUP BY ALL), p AS (SELECT vec_id, t, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, j::INTEGER AS j, round(sum(p * v), 7) + 0.0::DOUBLE AS y FROM p JOIN r USING (vec_id, t) GROUP BY vec_id, j")
def attention_pooling(spark, sf_dir):
    """A score for each step, softmax, and the weighted mean of the steps."""
    weights = F.array(*(F.lit((j + 1) / 10) for j in range(8)))

    def pool(r):
        return V.let(V.softmax(F.transform(r, lambda a: F.tanh(V.dot(a, weights)))), lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: V.total(F.zip_with(p, r, lambda w, a: w * F.get(a, j)))))

    return vectors(spark, sf_dir).select("vec_id", F.posexplode(V.let(V.rows_of(F.col("x"), 8), pool)).alias("j", "y")).select("vec_id", "j", rounded(F.col("y"), 7).alias("y"))


@register(f"WITH {_X}, a AS (SELECT vec_id, i, v + 0.5 * tanh(v) AS z FROM l) SELECT vec_id, i::INTEGER AS pos, round((z - avg(z) OVER (PARTITION BY vec_id)) / sqrt(var_pop(z) OVER (PARTITION BY vec_id) + 1e-8), 6) + 0.0::DOUBLE AS y FROM a")
def attention_add_norm(spark, sf_dir):
    z = V.layer_norm(F.transform("x", lambda v: v + 0.5 * F.tanh(v)))
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(z).alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y")).alias("y"))


@register(f"""WITH {_X}, s AS (SELECT a.vec_id, a.t AS q, b.t AS k, sum(a.v * b.v) AS s FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.j = b.j AND a.t <> b.t GROUP BY ALL),
p AS (SELECT vec_id, q, k, s - ln(sum(exp(s)) OVER (PARTITION BY vec_id, q)) AS lp FROM s) SELECT vec_id, round(-avg(lp), 7) AS loss FROM p WHERE k = (q + 4) % 8 GROUP BY vec_id""")
def loss_temporal_contrast(spark, sf_dir):
    """Each step against its other view, four steps on, among all other steps."""

    def loss(r):
        def one(a, i):
            s = F.transform(r, lambda b: V.dot(a, b))
            norm = F.log(V.total(F.transform(s, lambda v, k: F.when(k == i, 0.0).otherwise(F.exp(v)))))
            return F.get(s, ((i + 4) % 8)) - norm

        return -V.total(F.transform(r, one)) / 8

    return vectors(spark, sf_dir).select("vec_id", rounded(V.let(V.rows_of(F.col("x"), 8), loss), 7).alias("loss"))


@register(f"WITH {_X} SELECT vec_id, round(0.5 * sum(CASE WHEN i < 32 THEN v * v ELSE exp(v) - v - 1 END), 7) AS kl FROM l GROUP BY vec_id")
def loss_divergence(spark, sf_dir):
    """Of a normal with means in the first half and log variances in the second from the standard normal."""
    terms = F.transform("x", lambda v, i: F.when(i < 32, v * v).otherwise(F.exp(v) - v - 1))
    return vectors(spark, sf_dir).select("vec_id", rounded(0.5 * V.total(terms), 7).alias("kl"))


@register(f"WITH {_X} SELECT vec_id, round(-sum(ln(1 + exp(v)) - (CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) * v), 7) + 0.0::DOUBLE AS bernoulli, round(-0.5 * sum(2 * ln(1 + exp(v)) + pow((i % 3) / 2.0::DOUBLE - v, 2) / pow(1 + exp(v), 2)), 7) + 0.0::DOUBLE AS gaussian FROM l GROUP BY vec_id")
def reconstruction_probability(spark, sf_dir):
    softplus = S.log_one_plus_exp
    b = -V.total(F.transform("x", lambda v, i: softplus(v) - F.when(i % 2 == 0, v).otherwise(0.0)))
    g = -0.5 * V.total(F.transform("x", lambda v, i: 2 * softplus(v) + F.pow((i % 3) / 2.0 - v, F.lit(2)) / F.pow(1 + F.exp(v), F.lit(2))))
    return vectors(spark, sf_dir).select("vec_id", rounded(b, 7).alias("bernoulli"), rounded(g, 7).alias("gaussian"))


@register(f"WITH {_X}, s AS (SELECT i, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM l GROUP BY i) SELECT i::INTEGER AS pos, round(0.9 * 0 + 0.1 * m, 8) + 0.0::DOUBLE AS mean, round(0.9 * 1 + 0.1 * s * n / (n - 1), 8) AS variance FROM s")
def vec_batch_norm_running(spark, sf_dir):
    """Running statistics after one batch: momentum 0.1, unbiased variance."""
    s = vectors(spark, sf_dir).select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    return s.select("pos", rounded(0.1 * F.col("m"), 8).alias("mean"), rounded(0.9 + 0.1 * F.col("s"), 8).alias("variance"))


@register(f"WITH {_X}, b AS (SELECT vec_id, label, i, v, CASE label WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.25 END AS beta FROM l) SELECT vec_id, i::INTEGER AS pos, round(greatest(v, 0) + beta * least(v, 0), 8) + 0.0::DOUBLE AS y FROM b")
def act_prelu_channels(spark, sf_dir):
    """A slope for each channel, by a join with the slopes."""
    slopes = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, beta double")
    y = F.transform("x", lambda v: F.greatest(v, F.lit(0.0)) + F.coalesce("beta", F.lit(0.25)) * F.least(v, F.lit(0.0)))
    return vectors(spark, sf_dir).join(F.broadcast(slopes), "label", "left").select("vec_id", F.posexplode(y).alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 8).alias("y"))


@register(f"WITH {_X}, b AS (SELECT vec_id, i, v > 0 AS s, lead(v, 0) OVER (PARTITION BY vec_id ORDER BY i) > 0.05 AS t FROM l) SELECT vec_id, round(count(*) FILTER (s AND t) / count(*) FILTER (s OR t), 8) AS jaccard FROM b GROUP BY vec_id")
def vec_jaccard_bits(spark, sf_dir):
    both = F.size(F.filter("x", lambda v: v > 0.05))
    return vectors(spark, sf_dir).select("vec_id", rounded(F.try_divide(both, F.size(F.filter("x", lambda v: v > 0))), 8).alias("jaccard"))


@register("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_tax) AS b, var_pop(l_quantity) AS s, var_pop(l_tax) AS t, covar_pop(l_quantity, l_tax) AS c FROM lineitem)
SELECT l_returnflag AS g, round(avg((t * pow(l_quantity - a, 2) - 2 * c * (l_quantity - a) * (l_tax - b) + s * pow(l_tax - b, 2)) / (s * t - c * c)), 6) AS d FROM lineitem, m GROUP BY 1""")
def vec_mahalanobis(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    q, t = F.col("l_quantity"), F.col("l_tax")
    m = li.agg(F.avg(q).alias("a"), F.avg(t).alias("b"), F.var_pop(q).alias("s"), F.var_pop(t).alias("t"), F.covar_pop(q, t).alias("c"))
    u, v, c = q - F.col("a"), t - F.col("b"), F.col("c")
    d = (F.col("t") * u * u - 2 * c * u * v + F.col("s") * v * v) / (F.col("s") * F.col("t") - c * c)
    return li.join(F.broadcast(m)).groupBy(F.col("l_returnflag").alias("g")).agg(rounded(F.avg(d)).alias("d"))


@register("WITH d AS (SELECT doc_id, quality, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS y, n_chars / 1000.0::DOUBLE - 2 AS x FROM labels JOIN documents USING (doc_id)) SELECT min(doc_id) FILTER (y * (0.5 * x - 0.1) <= 0) AS first_error, count(*) FILTER (y * (0.5 * x - 0.1) <= 0) AS errors FROM d")
def perceptron_first_error(spark, sf_dir):
    """The row the next update of a fixed perceptron would take, and how many it gets wrong."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    wrong = F.when(F.col("quality") == 1, 1).otherwise(-1) * (0.5 * (F.col("n_chars") / 1000.0 - 2) - 0.1) <= 0
    return d.agg(F.min(F.when(wrong, F.col("doc_id"))).alias("first_error"), F.count_if(wrong).alias("errors"))


@register("WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), s AS (SELECT event_id, i // (n // 8) AS strip, i % (n // 8) AS step FROM o) SELECT strip, step // 16 AS window, count(*) AS n, min(event_id) AS first FROM s WHERE strip < 8 GROUP BY ALL")
def split_strips(spark, sf_dir):
    """Eight contiguous strips, each cut into steps of 16; what does not fill a strip is left out."""
    o = series.global_row_number(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"])
    n = o.agg(F.floor(F.count("*") / 8).alias("size"))
    s = o.join(F.broadcast(n)).select("event_id", F.floor((F.col("rn") - 1) / F.col("size")).alias("strip"), ((F.col("rn") - 1) % F.col("size")).alias("step"))
    return s.where("strip < 8").groupBy("strip", F.floor(F.col("step") / 16).alias("window")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("WITH t AS (SELECT sum(o_totalprice) AS s, count(*) AS n FROM orders) SELECT o_orderkey, round((s - o_totalprice) / (n - 1), 4) AS rest_mean FROM orders, t")
def split_leave_one_out(spark, sf_dir):
    """The mean of all other rows: every fold from one total."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    t = o.agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    return o.join(F.broadcast(t)).select("o_orderkey", rounded((F.col("s") - F.col("o_totalprice")) / (F.col("n") - 1), 4).alias("rest_mean"))


_KINDS = ("click", "error", "login", "purchase", "view")


@register("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}_value, (count(*) FILTER (event_type = '{k}') > 0)::INTEGER AS {k}_mark" for k in _KINDS) + " FROM events GROUP BY 1")
def prepare_wide_series(spark, sf_dir):
    """One column and one validity mark for each kind of series."""
    e = table(spark, sf_dir, "events")
    values = [c for k in _KINDS for c in (rounded(F.avg(F.when(F.col("event_type") == k, F.col("value")))).alias(f"{k}_value"), (F.count_if(F.col("event_type") == k) > 0).cast("int").alias(f"{k}_mark"))]
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*values)


@register("WITH w AS (SELECT event_id, user_id, event_type = 'error' AS bad, value, lag(value) OVER v AS a, lead(value) OVER v AS b, lag(event_type = 'error') OVER v AS ab, lead(event_type = 'error') OVER v AS bb FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(CASE WHEN bad AND NOT ab AND NOT bb THEN (a + b) / 2 ELSE value END, 6) AS value, NOT bad OR coalesce(NOT ab AND NOT bb, false) AS valid FROM w")
def prepare_single_gaps(spark, sf_dir):
    """A single invalid row between valid ones takes the mean of its neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    bad = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").select("event_id", "value", bad.alias("bad"), F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"), F.lag(bad).over(w).alias("ab"), F.lead(bad).over(w).alias("bb"))
    fit = F.coalesce(~F.col("ab") & ~F.col("bb"), F.lit(False))
    return e.select("event_id", rounded(F.when(F.col("bad") & fit, (F.col("a") + F.col("b")) / 2).otherwise(F.col("value"))).alias("value"), (~F.col("bad") | fit).alias("valid"))


@register("WITH m AS (SELECT avg(s_acctbal) AS a, stddev_samp(s_acctbal) AS b FROM supplier) SELECT s_suppkey, round(coalesce((s_acctbal - a) / b, 0), 7) + 0.0::DOUBLE AS balance, " + ", ".join(f"(s_nationkey % 3 = {k})::INTEGER AS nation_{k}" for k in range(3)) + " FROM supplier, m")
def prepare_dummies(spark, sf_dir):
    """Numbers z-scored by the sample deviation, categories as 0/1 columns."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 3).alias("n"))
    m = s.agg(F.avg("s_acctbal").alias("a"), F.stddev_samp("s_acctbal").alias("b"))
    z = F.coalesce(F.try_divide(F.col("s_acctbal") - F.col("a"), F.col("b")), F.lit(0.0))
    return s.join(F.broadcast(m)).select("s_suppkey", rounded(z, 7).alias("balance"), *((F.col("n") == k).cast("int").alias(f"nation_{k}") for k in range(3)))


@register("SELECT event_id, round((2 + CASE WHEN value > 20 THEN -1.5 ELSE 0 END + CASE WHEN value > 80 THEN 3 ELSE 0 END)::DOUBLE, 6) AS slope1, round(2 + 2 * 0.1 * value + CASE WHEN value > 20 THEN 2 * 0.05 * (value - 20) ELSE 0 END, 6) AS slope2 FROM events")
def series_spline_slope(spark, sf_dir):
    """Slopes at each value of splines of degree one and two with knots at 20 and 80."""
    v = F.col("value")
    one = 2 + F.when(v > 20, -1.5).otherwise(0.0) + F.when(v > 80, 3.0).otherwise(0.0)
    two = 2 + 0.2 * v + F.when(v > 20, 0.1 * (v - 20)).otherwise(0.0)
    return table(spark, sf_dir, "events").select("event_id", rounded(one).alias("slope1"), rounded(two).alias("slope2"))


@register("WITH d AS (SELECT event_type, date_trunc('day', ts) AS d, value > 150 AS odd FROM events) SELECT event_type, strftime(d, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (odd) AS odd FROM d GROUP BY ALL HAVING count(*) FILTER (odd) > 0")
def anomaly_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 150).alias("odd"))
    return e.where("odd > 0")


@register("WITH e AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id FROM events JOIN e USING (event_type) WHERE abs(value - m) > 3 * s")
def anomaly_deviations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(F.broadcast(s), "event_type").where(F.abs(F.col("value") - F.col("m")) > 3 * F.col("s")).select("event_id")


_N1, _N2 = 15 * math.sqrt(2 * math.pi), 60 * math.sqrt(2 * math.pi)


@register(f"SELECT event_type, round(avg(ln(greatest(0.4 * exp(-pow((value - 20) / 15, 2) / 2) / {_N1!r}::DOUBLE + 0.6 * exp(-pow((value - 90) / 60, 2) / 2) / {_N2!r}::DOUBLE, 1e-100))), 7) AS log_likelihood FROM events GROUP BY event_type")
def gmm_log_likelihood(spark, sf_dir):
    v = F.col("value")
    p = sum((w * F.exp(-F.pow((v - m) / s, F.lit(2)) / 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in ((0.4, 20.0, 15.0), (0.6, 90.0, 60.0))), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rounded(F.avg(F.log(F.greatest(p, F.lit(1e-100)))), 7).alias("log_likelihood"))


@register("WITH c AS (SELECT item_id, unnest(string_split(lower(text), '')) AS ch, unnest(range(0, length(text))) AS pos FROM benchmark) SELECT ch, nx, count(*) AS n FROM (SELECT item_id, ch, lead(ch) OVER (PARTITION BY item_id ORDER BY pos) AS nx FROM c) WHERE nx IS NOT NULL GROUP BY ALL")
def text_next_characters(spark, sf_dir):
    """Pairs of a character and the next one, counted."""
    c = table(spark, sf_dir, "benchmark").select(F.filter(F.split(F.lower("text"), ""), lambda x: x != "").alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("ch"), F.element_at("c", i + 1).alias("nx")))
    return c.where(F.size("c") > 1).select(F.inline(pairs)).groupBy("ch", "nx").agg(F.count("*").alias("n"))
