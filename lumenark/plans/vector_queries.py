"""Array functions, pooling, convolution, attention and neighbours over the embeddings, each as (vec_id, pos, y) rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import vector as V
from lumenark.operators.neighbours import nearest
from lumenark.plans.kit import Query, rounded, table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _long(value) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors(spark, sf_dir).select("vec_id", F.posexplode(value()).alias("pos", "y")).select("vec_id", "pos", rounded(F.col("y"), 7).alias("y"))

    return query


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e)"


def _sql(body: str) -> str:
    return f"WITH {_E} {body}"


def _w(expression: str, frm: str = "l") -> str:
    return _sql(f"SELECT vec_id, i::INTEGER AS pos, round({expression}, 7) + 0.0::DOUBLE AS y FROM {frm}")


x = lambda: F.col("x")
_SMQ = "s AS (SELECT vec_id, i, v, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM l)"
_TABLE: dict[str, tuple] = {
    "vec_softmax": (lambda: V.softmax(x()), _w("exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id)")),
    "vec_log_softmax": (lambda: V.log_softmax(x()), _w("v - ln(sum(exp(v)) OVER (PARTITION BY vec_id))")),
    "vec_softmax_gradient": (lambda: V.let(V.softmax(x()), lambda p: V.softmax_gradient(p, x())), f"WITH {_E}, {_SMQ} SELECT vec_id, i::INTEGER AS pos, round(p * (v - sum(p * v) OVER (PARTITION BY vec_id)), 7) + 0.0::DOUBLE AS y FROM s"),
    "vec_layer_norm": (lambda: V.layer_norm(x()), _w("(v - avg(v) OVER (PARTITION BY vec_id)) / sqrt(var_pop(v) OVER (PARTITION BY vec_id) + 1e-8)")),
    "vec_max_pool": (lambda: V.max_pool(x(), 4), _sql("SELECT vec_id, (i // 4)::INTEGER AS pos, round(max(v), 7) + 0.0::DOUBLE AS y FROM l GROUP BY vec_id, i // 4")),
    "vec_avg_pool": (lambda: V.avg_pool(x(), 4), _sql("SELECT vec_id, (i // 4)::INTEGER AS pos, round(avg(v), 7) + 0.0::DOUBLE AS y FROM l GROUP BY vec_id, i // 4")),
    "vec_maxout": (lambda: V.max_pool(x(), 2), _sql("SELECT vec_id, (i // 2)::INTEGER AS pos, round(max(v), 7) + 0.0::DOUBLE AS y FROM l GROUP BY vec_id, i // 2")),
    "vec_conv1d": (lambda: V.conv1d(x(), [0.25, 0.5, -0.25]), _sql("SELECT vec_id, i::INTEGER AS pos, round(0.25 * x[i + 1] + 0.5 * x[i + 2] - 0.25 * x[i + 3], 7) + 0.0::DOUBLE AS y FROM (SELECT vec_id, x, unnest(range(0, len(x) - 2)) AS i FROM e)")),
    "vec_conv1d_strided": (lambda: V.conv1d(x(), [0.25, 0.5, -0.25], 2, 3), _sql("SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1)::INTEGER AS pos, round(0.25 * x[i + 1] + 0.5 * x[i + 4] - 0.25 * x[i + 7], 7) + 0.0::DOUBLE AS y FROM (SELECT vec_id, x, unnest(range(0, len(x) - 6, 2)) AS i FROM e)")),
    "vec_causal_conv": (lambda: V.causal_conv(x(), [0.3, 0.7], 2), _sql("SELECT vec_id, i::INTEGER AS pos, round(0.3 * CASE WHEN i >= 2 THEN x[i - 1] ELSE 0 END + 0.7 * x[i + 1], 7) + 0.0::DOUBLE AS y FROM (SELECT vec_id, x, unnest(range(0, len(x))) AS i FROM e)")),
    "vec_one_hot": (lambda: V.one_hot(F.col("label"), 10), "SELECT vec_id, k::INTEGER AS pos, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM embeddings, range(0, 10) t(k)"),
    "vec_label_smoothing": (lambda: V.label_smoothing(F.col("label"), 10), "SELECT vec_id, k::INTEGER AS pos, CASE WHEN k = label THEN 0.9::DOUBLE ELSE round(0.1::DOUBLE / 9, 7) END AS y FROM embeddings, range(0, 10) t(k)"),
    "vec_positional_encoding": (lambda: F.transform(x(), lambda v, i: v + V.positional_encoding(F.col("label"), i, 64)), _w("v + CASE WHEN i % 2 = 0 THEN sin(label / pow(10000.0::DOUBLE, 2 * (i // 2) / 64.0::DOUBLE)) ELSE cos(label / pow(10000.0::DOUBLE, 2 * (i // 2) / 64.0::DOUBLE)) END")),
    "vec_dot_attention": (
        lambda: V.let(V.rows_of(x(), 8), lambda r: F.flatten(V.dot_attention(r, r, r, 8))),
        f"""WITH {_E}, r AS (SELECT vec_id, i // 8 AS t, i % 8 AS j, v FROM l),
s AS (SELECT a.vec_id, a.t AS q, b.t AS k, sum(a.v * b.v) / sqrt(8.0::DOUBLE) AS s FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.j = b.j GROUP BY ALL),
p AS (SELECT vec_id, q, k, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id, q) AS p FROM s)
SELECT p.vec_id, (q * 8 + j)::INTEGER AS pos, round(sum(p * v), 7) + 0.0::DOUBLE AS y FROM p JOIN r ON r.vec_id = p.vec_id AND r.t = p.k GROUP BY p.vec_id, q, j""",
    ),
    "vec_gated_addition": (lambda: V.let(F.reverse(x()), lambda z: F.zip_with(x(), z, lambda a, b: V.let(1 / (1 + F.exp(-(0.5 * a - 0.25 * b))), lambda g: g * a + (1 - g) * b))), _sql("SELECT vec_id, i::INTEGER AS pos, round(a / (1 + exp(-(0.5 * a - 0.25 * b))) + (1 - 1 / (1 + exp(-(0.5 * a - 0.25 * b)))) * b, 7) + 0.0::DOUBLE AS y FROM (SELECT vec_id, i, v AS a, last_value(v) OVER (PARTITION BY vec_id ORDER BY 63 - i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z, lead(v, 0) OVER (PARTITION BY vec_id ORDER BY i) AS y0 FROM l) JOIN (SELECT vec_id AS v2, 63 - i AS i2, v AS b FROM l) ON vec_id = v2 AND i = i2")),
    "vec_seq2col": (lambda: F.flatten(V.windows(x(), 3, 2, lambda w: w)), _sql("SELECT vec_id, (3 * (s // 2) + k)::INTEGER AS pos, round(x[s + k + 1], 7) + 0.0::DOUBLE AS y FROM (SELECT vec_id, x, unnest(range(0, len(x) - 2, 2)) AS s FROM e), range(0, 3) t(k)")),
}
QUERIES: dict[str, Query] = {n: _long(f) for n, (f, _) in _TABLE.items()}
SQL: dict[str, str] = {n: s for n, (_, s) in _TABLE.items()}


def _per_vector(values) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir)
        return df.select("vec_id", *(rounded(c, 7).alias(n) for n, c in values().items()))

    return query


QUERIES["vec_global_pooling"] = _per_vector(lambda: {"largest": F.array_max("x"), "mean": V.total(x()) / F.size("x")})
SQL["vec_global_pooling"] = _sql("SELECT vec_id, round(list_max(x), 7) + 0.0::DOUBLE AS largest, round(list_sum(x) / len(x), 7) + 0.0::DOUBLE AS mean FROM e")


def batch_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place over all vectors: normalised by its mean and population variance; a fixed set of 64 groups."""
    long = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("pos", "v"))
    stats = long.groupBy("pos").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return long.join(F.broadcast(stats), "pos").select("vec_id", "pos", rounded((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + 1e-8), 6).alias("y"))


QUERIES["vec_batch_norm"] = batch_norm
SQL["vec_batch_norm"] = _sql("SELECT vec_id, i::INTEGER AS pos, round((v - avg(v) OVER (PARTITION BY i)) / sqrt(var_pop(v) OVER (PARTITION BY i) + 1e-8), 6) + 0.0::DOUBLE AS y FROM l")


def _centroid(df: DataFrame) -> DataFrame:
    """The mean vector, one row; sums combine by place before the shuffle."""
    means = df.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distance of each vector from the mean vector."""
    df = vectors(spark, sf_dir)
    both = df.join(F.broadcast(_centroid(df)))
    c = F.col("c")
    return both.select("vec_id", *(rounded(d, 6).alias(n) for n, d in {"squared": V.squared_distance(x(), c), "manhattan": V.manhattan(x(), c), "chebyshev": V.chebyshev(x(), c), "minkowski3": V.minkowski(x(), c, 3.0), "cosine": V.cosine(x(), c)}.items()))


QUERIES["vec_distances"] = distances
SQL["vec_distances"] = _sql("""SELECT vec_id, round(sum((v - c) * (v - c)), 6) + 0.0::DOUBLE AS squared, round(sum(abs(v - c)), 6) + 0.0::DOUBLE AS manhattan, round(max(abs(v - c)), 6) + 0.0::DOUBLE AS chebyshev,
 round(pow(sum(pow(abs(v - c), 3)), 1.0::DOUBLE / 3), 6) + 0.0::DOUBLE AS minkowski3, round(sum(v * c) / sqrt(sum(v * v) * sum(c * c)), 6) + 0.0::DOUBLE AS cosine
FROM (SELECT *, avg(v) OVER (PARTITION BY i) AS c FROM l) GROUP BY vec_id""")


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority label of the 5 nearest vectors, for every vector whose id is divisible by 20; ties to the nearer label."""
    df = vectors(spark, sf_dir)
    near = nearest(df, 5, "squared", df.where("vec_id % 20 = 0"))
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    return votes.groupBy("query_id").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", (-F.col("first")).alias("f"))).alias("b")).select("query_id", F.col("b.label").alias("label"), F.col("b.votes").alias("votes"))


_NEAR = f"""WITH {_E}, q AS (SELECT vec_id AS query_id, i, v AS u FROM l WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id, any_value(label) AS label, sum((u - v) * (u - v)) AS d, sum(u * v) / sqrt(sum(u * u) * sum(v * v)) AS c FROM q JOIN l USING (i) WHERE query_id <> vec_id GROUP BY query_id, vec_id)"""
QUERIES["knn_vote"] = knn_vote
SQL["knn_vote"] = f"""{_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d QUALIFY rank <= 5),
v AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM r GROUP BY ALL)
SELECT query_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1"""


def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most cosine-similar vectors of every vector whose id is divisible by 20."""
    df = vectors(spark, sf_dir)
    return nearest(df, 5, "cosine", df.where("vec_id % 20 = 0")).select("query_id", "vec_id", "rank", rounded(-F.col("d")).alias("similarity"))


QUERIES["most_similar"] = most_similar
SQL["most_similar"] = f"{_NEAR} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::INTEGER AS rank, round(c, 6) + 0.0::DOUBLE AS similarity FROM d QUALIFY rank <= 5"

