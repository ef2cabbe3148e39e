"""Tokens, vocabularies and n-grams as DataFrame operations; counts combine before the shuffle, hot words are pre-aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def letters_only(line: Column) -> Column:
    """Runs of other characters than letters as one space, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(line, "[^A-Za-z]+", " ")))


def sentence_tokens(text: Column) -> Column:
    """Lower case, full stops as tokens of their own, split at single spaces."""
    return F.filter(F.split(F.replace(F.lower(text), F.lit("."), F.lit(" .")), " "), lambda w: w != "")


def translation_tokens(line: Column) -> Column:
    """No-break spaces as spaces, lower case, a space before , . ! and ?, split at spaces."""
    plain = F.lower(F.translate(line, " \xa0", "  "))
    return F.split(F.regexp_replace(plain, "([^ ])([,.!?])", "$1 $2"), " ")


def truncated(tokens: Column, size: int, padding: str) -> Column:
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(padding), size)), 1, size)


def positions(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, pos, word) in long form; empty documents have no rows."""
    return df.select(doc, F.posexplode(tokens).alias("pos", "word"))


def vocabulary(long: DataFrame, doc: str, least: int = 1, first_id: int = 0) -> DataFrame:
    """(word, n, id): words by falling count, equal counts by first occurrence; ids go up from first_id.

    Words are numbered inside ranges of their count and shifted by the words of larger counts, so no task sorts all words.
    """
    counts = long.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct(doc, "pos")).alias("first")).where(F.col("n") >= least)
    sizes = counts.groupBy("n").agg(F.count("*").alias("c"))
    before = sizes.select("n", (F.sum("c").over(Window.orderBy(F.desc("n"))) - F.col("c")).alias("before"))
    numbered = counts.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("first")))
    return numbered.join(F.broadcast(before), "n").select("word", "n", (F.col("r") - 1 + F.col("before") + first_id).alias("id"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def cooccurrence(df: DataFrame, tokens: Column, window: int = 1) -> DataFrame:
    """(a, b, n): how often b stands within `window` places of a in the same document, both ways.

    Neighbours stand in the same row, so nothing is shuffled before the counts, which combine before their shuffle.
    """
    pairs = F.flatten(F.array(*(F.zip_with("w", F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))) for k in range(1, window + 1))))
    ahead = df.select(tokens.alias("w")).select(F.inline(pairs)).where("b is not null")
    one = ahead.groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def context_windows(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, pos, target, context): each token that has a neighbour on both sides, and these. Read from the row, without a shuffle."""
    around = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("target"), F.concat_ws(" ", F.get("w", i - 1), F.get("w", i + 1)).alias("context")))
    inner = F.when(F.size("w") > 2, F.slice(around, F.lit(2), F.size("w") - 2))
    return df.select(doc, tokens.alias("w")).select(doc, F.inline(inner))


def ppmi(counts: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(a, b, ppmi) of a co-occurrence table: max(0, log2(n * all / (n_a * n_b) + epsilon))."""
    rows = counts.groupBy("a").agg(F.sum("n").alias("na"))
    cols = counts.groupBy("b").agg(F.sum("n").alias("nb"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(rows, "a").join(cols, "b").join(F.broadcast(total)).select("a", "b", F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double") * F.col("all") / (F.col("na") * F.col("nb").cast("double")) + epsilon)).alias("ppmi"))


def clipped_matches(prediction: Column, reference: Column) -> Column:
    """How many n-grams of the prediction the reference has, each as often as in the reference at most."""
    def of(g: Column) -> Column:
        return F.least(F.size(F.filter(prediction, lambda x: x == g)), F.size(F.filter(reference, lambda x: x == g)))

    return F.aggregate(F.array_distinct(prediction), F.lit(0), lambda a, g: a + of(g))


def bleu(prediction: Column, reference: Column, k: int = 2) -> Column:
    """exp(min(0, 1 - len_ref / len_pred)) times the n-gram precisions to the power 1/2**n; 0 for an empty prediction."""
    score = F.exp(F.least(F.lit(0.0), 1 - F.try_divide(F.size(reference), F.size(prediction))))
    for n in range(1, k + 1):
        p, r = ngrams(prediction, n), ngrams(reference, n)
        score = score * F.pow(F.coalesce(F.try_divide(clipped_matches(p, r), F.size(p)), F.lit(0.0)), F.lit(0.5**n))
    return F.when(F.size(prediction) == 0, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
