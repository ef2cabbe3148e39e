"""Gain ratios, discrete splits, and models fitted to rest over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenark.operators import classify, cluster, sampling
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


@register("""WITH x AS (SELECT l_returnflag AS label, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem),
u AS (SELECT DISTINCT feature, value FROM x), k AS (SELECT feature, value AS v, (value + lead(value) OVER (PARTITION BY feature ORDER BY value)) / 2 AS cut FROM u),
h AS (SELECT feature, value, label, count(*)::DOUBLE AS n FROM x GROUP BY ALL), c AS (SELECT l_returnflag AS label, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), y AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hy FROM c),
s AS (SELECT k.feature, k.cut, h.value <= k.v AS side, label, sum(n) AS n FROM k JOIN h USING (feature) WHERE cut IS NOT NULL GROUP BY ALL),
i AS (SELECT feature, cut, side, sum(n) AS t, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS e FROM s GROUP BY ALL),
g AS (SELECT feature, i.cut, any_value(hy) - sum(e) / sum(t) AS gain, log2(sum(t)) - sum(t * log2(t)) / sum(t) AS own FROM i, y GROUP BY feature, i.cut)
SELECT feature, round(cut, 6) AS cut, round(gain / own, 8) + 0.0::DOUBLE AS ratio FROM g""")
def tree_gain_ratio(spark, sf_dir):
    """The information gain of each cut over the entropy of its two sides' sizes."""
    hist = classify.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    splits = classify.class_splits(hist).select("feature", "cut", "entropy")
    of = hist.groupBy("feature", "label").agg(F.sum("n").alias("n")).groupBy("feature").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l")).select("feature", "t", (F.log2("t") - F.col("l") / F.col("t")).alias("hy"))
    sizes = hist.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    left = splits.join(F.broadcast(sizes), "feature").where(F.col("value") <= F.col("cut")).groupBy("feature", "cut", "entropy").agg(F.sum("n").alias("a")).join(F.broadcast(of), "feature")
    p = F.col("a") / F.col("t")
    own = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return left.select("feature", rounded(F.col("cut")).alias("cut"), rounded((F.col("hy") - F.col("entropy")) / own, 8).alias("ratio"))


@register("""WITH c AS (SELECT o_orderpriority AS v, o_orderstatus AS y, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), s AS (SELECT v, sum(n) AS t, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS e, sum(n) - sum(n * n) / sum(n) AS g FROM c GROUP BY v)
SELECT count(*) AS branches, round(sum(e) / sum(t), 8) AS entropy, round(sum(g) / sum(t), 8) AS gini FROM s""")
def tree_discrete_split(spark, sf_dir):
    """A branch for each value of a discrete feature."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("v"), "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    s = c.groupBy("v").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return s.agg(F.count("*").alias("branches"), rounded(F.sum(F.col("t") * F.log2("t") - F.col("l")) / F.sum("t"), 8).alias("entropy"), rounded(F.sum(F.col("t") - F.col("q") / F.col("t")) / F.sum("t"), 8).alias("gini"))


@register()
def kmeans_choose(spark, sf_dir):
    """Errors of k = 1..4 from weighted far-apart starts, and the elbow among them."""
    df = vectors(spark, sf_dir)
    first = df.orderBy(sampling.uniform(3, "vec_id"), "vec_id").limit(1).collect()[0].x
    centres, errors = [first], []
    for k in range(1, 5):
        best, error = cluster.lloyd(df, np.array(centres, float), 3)
        errors.append((k, float(error)))
        c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(best)], "cid int, c array<double>")
        far = sampling.roulette(cluster.assigned(df, c), "d", "vec_id", seed=k).orderBy(F.desc("priority"), "vec_id").limit(1)
        centres = [*best.tolist(), far.collect()[0].x]
    e = spark.createDataFrame(errors, "k int, error double")
    return e.join(F.broadcast(cluster.elbow(e).withColumnRenamed("k", "best"))).select("k", "error", (F.col("k") == F.col("best")).alias("elbow"))


@register()
def gmm_fit(spark, sf_dir):
    """A mixture of three normals by the library that comes with Spark; weights and means."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    e = table(spark, sf_dir, "events").select("value", F.hour("ts").cast("double").alias("hour"))
    m = GaussianMixture(k=3, seed=5, maxIter=10).fit(VectorAssembler(inputCols=["value", "hour"], outputCol="features").transform(e))
    return spark.createDataFrame([(float(w), float(g.mean[0]), float(g.mean[1])) for w, g in zip(m.weights, (r for r in m.gaussians), strict=True)], "weight double, value double, hour double")


#: Characters of text for each task of the skip-gram learner. A task trains its own copy of the vectors; the learner averages
#: a word's vectors over the tasks that met it. Texts of up to so many characters are trained by one task.
PART_CHARS = 16_000_000


def skip_gram(df, text: str = "text"):
    """The learner for a column w of words of df, with as many tasks as its texts need."""
    from pyspark.ml.feature import Word2Vec

    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return Word2Vec(vectorSize=16, minCount=20, seed=3, maxIter=1, numPartitions=max(1, -(-chars // PART_CHARS)), inputCol="w", outputCol="v")


@register()
def embedding_train(spark, sf_dir):
    """Word vectors of all documents by the skip-gram learner that comes with Spark."""
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+").alias("w"))
    model = skip_gram(docs).fit(words)
    return model.getVectors().select("word", rounded(F.sqrt(F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, v: a + v * v))).alias("norm"))
