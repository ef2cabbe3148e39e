"""Sampling, anomaly scores, sequence cells and networks over whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from lumenark.functions import vector as V
from lumenark.operators import anomaly, network, sampling, sequence
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


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


@register("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS repeats FROM orders")
def sample_duplicates(spark, sf_dir):
    return sampling.duplicates(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "repeats")


@register("SELECT o_orderstatus, ceil(count(*) * 0.7)::BIGINT AS train, count(*) - ceil(count(*) * 0.7)::BIGINT AS test FROM orders GROUP BY o_orderstatus")
def sample_hold_out(spark, sf_dir):
    """Sizes of a stratified hold-out: exact, whichever rows the hashes choose."""
    h = sampling.hold_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 0.7, "o_orderstatus", "o_orderkey")
    return h.groupBy("o_orderstatus").agg(F.sum(F.col("train").cast("long")).alias("train"), F.sum((~F.col("train")).cast("long")).alias("test"))


@register()
def sample_bootstrap(spark, sf_dir):
    return sampling.bootstrap(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@register()
def sample_folds(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(sampling.folds("o_orderkey", 5).alias("fold")).agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 2).alias("mean"))


@register()
def sample_roulette(spark, sf_dir):
    """The 100 orders drawn first, in proportion to their price; the top-k is the operator."""
    return sampling.roulette(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").orderBy(F.desc("priority"), "o_orderkey").limit(100)


@register()
def iforest_scores(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").alias("hour"), "user_id")
    return anomaly.isolation_scores(d, "event_id", ["value", "hour", "user_id"])


@register()
def cutforest_scores(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").alias("hour"))
    return anomaly.cut_scores(d, "event_id", ["value", "hour"], trees=10)


@register(f"WITH RECURSIVE {_E}, r AS (SELECT vec_id, x, 0 AS i, 0.0::DOUBLE AS h FROM e UNION ALL SELECT vec_id, x, i + 1, tanh(0.8 * x[i + 1] + 0.5 * h + 0.1) FROM r WHERE i < len(x)) SELECT vec_id, round(h, 7) + 0.0::DOUBLE AS h FROM r WHERE i = len(x)")
def rnn_state(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(sequence.rnn(F.col("x"), 0.8, 0.5, 0.1), 7).alias("h"))


_SG = "1 / (1 + exp(-({})))"


@register(f"""WITH RECURSIVE {_E}, r AS (SELECT vec_id, x, 0 AS i, 0.0::DOUBLE AS h FROM e UNION ALL
SELECT vec_id, x, i + 1, (SELECT z * (h - a) + a FROM (SELECT {_SG.format('0.4 * x[i + 1] - 0.2 * h')} AS z, tanh(0.9 * x[i + 1] + {_SG.format('0.3 * x[i + 1] + 0.6 * h')} * h * 0.7) AS a)) FROM r WHERE i < len(x)) SELECT vec_id, round(h, 7) + 0.0::DOUBLE AS h FROM r WHERE i = len(x)""")
def gru_state(spark, sf_dir):
    w = {"wr": 0.3, "ur": 0.6, "wz": 0.4, "uz": -0.2, "wa": 0.9, "ua": 0.7}
    return vectors(spark, sf_dir).select("vec_id", rounded(sequence.gru(F.col("x"), w), 7).alias("h"))


@register(f"""WITH RECURSIVE {_E}, r AS (SELECT vec_id, x, 0 AS i, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c FROM e UNION ALL
SELECT vec_id, x, i + 1, {_SG.format('0.2 * x[i + 1] + 0.5 * h')} * tanh({_SG.format('0.5 * x[i + 1] + 0.1 * h')} * c + {_SG.format('0.6 * x[i + 1] - 0.3 * h')} * tanh(1.1 * x[i + 1] + 0.4 * h)), {_SG.format('0.5 * x[i + 1] + 0.1 * h')} * c + {_SG.format('0.6 * x[i + 1] - 0.3 * h')} * tanh(1.1 * x[i + 1] + 0.4 * h) FROM r WHERE i < len(x))
SELECT vec_id, round(h, 7) + 0.0::DOUBLE AS h FROM r WHERE i = len(x)""")
def lstm_state(spark, sf_dir):
    w = {"wf": 0.5, "uf": 0.1, "wi": 0.6, "ui": -0.3, "wo": 0.2, "uo": 0.5, "ws": 1.1, "us": 0.4}
    return vectors(spark, sf_dir).select("vec_id", rounded(sequence.lstm(F.col("x"), w), 7).alias("h"))


@register(f"WITH {_E}, l AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e) SELECT vec_id, o::INTEGER AS o, round(sum(v * ((i * 7 + o * 3) % 11 - 5) / 10.0::DOUBLE) + o * 0.1, 6) + 0.0::DOUBLE AS y FROM l, range(0, 4) t(o) GROUP BY vec_id, o")
def affine_layer(spark, sf_dir):
    w = [[((i * 7 + o * 3) % 11 - 5) / 10.0 for i in range(64)] for o in range(4)]
    ys = F.array(*(V.dot(F.col("x"), F.array(*map(F.lit, row))) + o * 0.1 for o, row in enumerate(w)))
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(ys).alias("o", "y")).select("vec_id", "o", rounded(F.col("y")).alias("y"))


@register()
def transformer_encode(spark, sf_dir):
    """Two encoder blocks over each vector as 8 steps of 8."""
    y = sequence.map_sequences(vectors(spark, sf_dir), "vec_id", "x", sequence.encoder(8), 8)
    return y.select("vec_id", rounded(V.total(F.transform("y", lambda v: v * v))).alias("norm"))


@register()
def network_classify(spark, sf_dir):
    """A network trained on the vectors' labels; counts of its votes."""
    df = vectors(spark, sf_dir).select("vec_id", "label", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(64)))
    names = [f"x{i}" for i in range(64)]
    net, _ = network.train(df, names, "label", [32, 10], "softmax", epochs=8, rate=0.05)
    votes = network.predict(df, "vec_id", names, net).select("vec_id", (F.array_position("y", F.array_max("y")) - 1).cast("int").alias("predicted"))
    return votes.join(df.select("vec_id", "label"), "vec_id").groupBy("label", "predicted").agg(F.count("*").alias("n"))


