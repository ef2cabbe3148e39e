"""Text preparation over whole documents and benchmark items: tokens, vocabularies, co-occurrence, windows, n-gram scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.functions import text as T
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


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "documents"), T.sentence_tokens(F.coalesce(F.col("text"), F.lit("")))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokens = _tokens(spark, sf_dir)
    return T.positions(docs, "doc_id", tokens)


_L = "t AS (SELECT doc_id, list_filter(string_split(replace(lower(coalesce(text, '')), '.', ' .'), ' '), lambda w: w <> '') AS w FROM documents), l AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM t)"
_V = f"{_L}, c AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS f FROM l GROUP BY word), v AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS id FROM c)"


@register(f"WITH {_L} SELECT doc_id, len(w)::INTEGER AS n, len(list_distinct(w))::INTEGER AS words FROM t")
def text_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentence_tokens(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("words"))


@register(f"WITH {_V} SELECT word, n, id FROM v")
def text_vocabulary(spark, sf_dir):
    return T.vocabulary(_long(spark, sf_dir), "doc_id")


@register(f"WITH {_V} SELECT word, n, id + 1 AS id FROM v WHERE n >= 5")
def text_vocabulary_cut(spark, sf_dir):
    return T.vocabulary(_long(spark, sf_dir), "doc_id", 5, 1)


@register(f"WITH {_V}, k AS (SELECT word, id + 1 AS id FROM v WHERE n >= 5) SELECT doc_id, count(*) AS n, count(k.id) AS known, coalesce(sum(k.id), 0)::BIGINT AS ids FROM l LEFT JOIN k USING (word) GROUP BY doc_id")
def text_corpus_ids(spark, sf_dir):
    """Ids of all words, 0 for unknown ones, summed for each document."""
    long = _long(spark, sf_dir)
    v = T.vocabulary(long, "doc_id", 5, 1).select("word", "id")
    return long.join(v, "word", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("id").alias("known"), F.sum(F.coalesce("id", F.lit(0))).alias("ids"))


@register(f"WITH {_L}, c AS (SELECT word, min({{'d': doc_id, 'p': pos}}) AS f FROM l GROUP BY word) SELECT word, row_number() OVER (ORDER BY f) - 1 AS id FROM c")
def text_first_occurrence_ids(spark, sf_dir):
    """Ids by first occurrence: words are numbered inside the document that has them first and shifted by those before."""
    first = _long(spark, sf_dir).groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    own = first.withColumn("r", F.row_number().over(Window.partitionBy("f.doc_id").orderBy("f.pos")))
    sizes = first.groupBy(F.col("f.doc_id").alias("d")).agg(F.count("*").alias("c"))
    block = F.floor(F.col("d") / 1024)
    blocks = sizes.groupBy(block.alias("b")).agg(F.sum("c").alias("c")).select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("base"))
    before = sizes.withColumn("b", block).join(F.broadcast(blocks), "b").select("d", (F.sum("c").over(Window.partitionBy("b").orderBy("d")) - F.col("c") + F.col("base")).alias("before"))
    return own.join(before, F.col("f.doc_id") == F.col("d")).select("word", (F.col("r") - 1 + F.col("before")).alias("id"))


_CO = f"{_L}, p AS (SELECT word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l), o AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), m AS (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT a, b, n FROM o UNION ALL SELECT b, a, n FROM o) GROUP BY ALL)"


@register(f"WITH {_CO} SELECT a, b, n FROM m")
def text_cooccurrence(spark, sf_dir):
    return T.cooccurrence(*_tokens(spark, sf_dir))


@register(f"WITH {_CO}, r AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM m) SELECT a, b, round(greatest(0, log2(n::DOUBLE * t / (na * nb::DOUBLE) + 1e-8)), 6) + 0.0::DOUBLE AS ppmi FROM r")
def text_ppmi(spark, sf_dir):
    return T.ppmi(T.cooccurrence(*_tokens(spark, sf_dir))).select("a", "b", rounded(F.col("ppmi")).alias("ppmi"))


@register(f"WITH {_L}, c AS (SELECT word, pow(count(*), 0.75) AS w FROM l GROUP BY word) SELECT word, round(w / sum(w) OVER (), 10) AS p FROM c")
def text_sampling_weights(spark, sf_dir):
    c = _long(spark, sf_dir).groupBy("word").agg(F.pow(F.count("*"), F.lit(0.75)).alias("w"))
    return c.join(F.broadcast(c.agg(F.sum("w").alias("t")))).select("word", rounded(F.col("w") / F.col("t"), 10).alias("p"))


@register(f"WITH {_L}, w AS (SELECT doc_id, pos, word, lag(word) OVER v AS a, lead(word) OVER v AS b FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos::INTEGER AS pos, word AS target, a || ' ' || b AS context FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def text_context_windows(spark, sf_dir):
    docs, tokens = _tokens(spark, sf_dir)
    return T.context_windows(docs, "doc_id", tokens)


@register("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')))) AS h FROM documents WHERE text IS NOT NULL")
def text_letters_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(T.letters_only(F.col("text")), 256).alias("h"))


@register("SELECT item_id, len(w)::INTEGER AS n, array_to_string((w || ['<eos>'] || list_transform(range(0, 60), lambda i: '<pad>'))[1:60], ' ') AS padded, least(len(w) + 1, 60)::INTEGER AS valid FROM (SELECT item_id, string_split(regexp_replace(lower(text), '([^ ])([,.!?])', '\\1 \\2', 'g'), ' ') AS w FROM benchmark)")
def text_translation_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.translation_tokens(F.col("text")).alias("w"))
    return b.select("item_id", F.size("w").alias("n"), F.array_join(T.truncated(F.concat("w", F.array(F.lit("<eos>"))), 60, "<pad>"), " ").alias("padded"), F.least(F.size("w") + 1, F.lit(60)).alias("valid"))


@register("""WITH b AS (SELECT item_id, string_split(lower(text), ' ') AS r, list_filter(string_split(lower(text), ' '), lambda w, i: i % 7 <> 3) AS p FROM benchmark),
g AS (SELECT item_id, len(r) AS lr, len(p) AS lp, p AS p1, r AS r1, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) AS p2, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS r2 FROM b),
m AS (SELECT *, list_sum(list_transform(list_distinct(p1), lambda x: least(len(list_filter(p1, lambda y: y = x)), len(list_filter(r1, lambda y: y = x))))) AS m1, list_sum(list_transform(list_distinct(p2), lambda x: least(len(list_filter(p2, lambda y: y = x)), len(list_filter(r2, lambda y: y = x))))) AS m2 FROM g)
SELECT item_id, round(exp(least(0, 1 - lr / lp)) * pow(m1 / len(p1), 0.5) * pow(m2 / len(p2), 0.25), 6) AS bleu FROM m""")
def text_bleu(spark, sf_dir):
    """Of each item with every seventh word left out against the item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("r"))
    p = b.withColumn("p", F.filter("r", lambda w, i: (i + 1) % 7 != 3))
    return p.select("item_id", rounded(T.bleu(F.col("p"), F.col("r"))).alias("bleu"))


@register("""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS w FROM documents),
b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS v FROM benchmark), l AS (SELECT item_id, unnest(v) AS word, len(v) AS nv FROM b), d AS (SELECT doc_id, unnest(w) AS word, len(w) AS nw FROM t),
p AS (SELECT item_id, doc_id, any_value(nv) AS nv, any_value(nw) AS nw, count(*) AS k FROM l JOIN d USING (word) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(k / (nv + nw - k), 6) AS jaccard FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k / (nv + nw - k) DESC, doc_id) = 1""")
def text_jaccard_nearest(spark, sf_dir):
    """The document whose words are most alike each benchmark item's, by an equi-join on words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")).alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("v"))
    d = words.select("doc_id", F.size("w").alias("nw"), F.explode("w").alias("word"))
    i = items.select("item_id", F.size("v").alias("nv"), F.explode("v").alias("word"))
    pairs = d.join(i, "word").groupBy("item_id", "doc_id", "nv", "nw").agg(F.count("*").alias("k"))
    score = pairs.select("item_id", "doc_id", (F.col("k") / (F.col("nv") + F.col("nw") - F.col("k"))).alias("j"))
    return score.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "j"), F.struct("j", (-F.col("doc_id")).alias("d"))).alias("b")).select("item_id", "b.doc_id", rounded(F.col("b.j")).alias("jaccard"))
