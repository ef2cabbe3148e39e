"""The skip-gram learner works in as many tasks as its texts need and loses no word."""

import math

from pyspark.sql import functions as F

from lumenark.plans import fit_queries


def test_long_texts_are_trained_in_several_tasks(spark, data, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    assert fit_queries.skip_gram(docs).getNumPartitions() == 1
    monkeypatch.setattr(fit_queries, "PART_CHARS", -(-chars // 5))
    assert fit_queries.skip_gram(docs).getNumPartitions() == 5
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+")).alias("w"))
    want = {r.w for r in words.groupBy("w").count().where("count >= 20").collect()}
    got = {r.word: r.norm for r in fit_queries.embedding_train(spark, data).collect()}
    assert got.keys() == want and all(math.isfinite(n) and n > 0 for n in got.values())


def test_no_text(spark):
    assert fit_queries.skip_gram(spark.createDataFrame([(None,)], "text string")).getNumPartitions() == 1
