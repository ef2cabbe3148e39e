"""Quality rules whose cutoffs are certified on labelled documents, in DataFrame functions only.

Each rule rejects texts whose score exceeds a cutoff. For every stratum (language) the good labelled documents are a
holdout on which a cutoff's false rejections are counted. A cutoff is certified if the exact binomial test refutes a
false-rejection rate above the rule's share of `risk`. Cutoffs of a rule are tested from the most lenient on and testing
stops at the first that fails (fixed-sequence testing); the level is divided by strata times rules (Bonferroni). So, with
probability 1 - `delta` over the labels, all chosen cutoffs together reject at most `risk` of the good documents of any
stratum. Among the certified cutoffs the one that catches most bad documents, less `cost` for each good one lost, is
taken; a stratum with too few labels certifies nothing and loses nothing to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch

SPACE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
RISK, DELTA, COST = 0.02, 0.05, 10
#: Scores in thousandths of the words (or lines), the word length in hundredths; cutoffs from lenient to strict.
SHARES = (5000, 3000, 2000, 1500, 1000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30, 20, 10)
CUTOFFS: dict[str, tuple[int, ...]] = {
    "symbols": SHARES,
    "dup_lines": tuple(x for x in SHARES if x <= 1000),
    "repeats": tuple(x for x in SHARES if x <= 1000),
    "word_length": (5000, 4000, 3000, 2500, 2000, 1800, 1600, 1500, 1400, 1300, 1200, 1100, 1000, 900, 800),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more; windows are compared by hash first, then word by word."""

    def slow(w: Column, h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, F.lit(5)) == F.slice(w, b["i"] + 1, F.lit(5)))

        def twice(s: Column) -> Column:
            marked = F.transform(s, lambda x, i: F.when(F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)), x["i"]))
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        def cover(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(5)), F.lit(5)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return _let(ordered, lambda s: _let(twice(s), cover))

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, 5))))
        return F.slice(hashes, F.lit(1), F.size(w) - 4)

    return _let(words, lambda w: F.when(F.size(w) < 6, F.lit(0)).otherwise(_let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(w, h)))))


def measures(text: Column) -> Column:
    """A struct of the base counts and n_lines, all long, of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    return _let(
        F.struct(words.alias("w"), counts.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (s["l"]["all"] - s["l"]["own"]).cast("long").alias("n_dup_lines"),
            _repeat_words(s["w"]).cast("long").alias("n_repeat_words"),
            s["l"]["all"].cast("long").alias("n_lines"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def scores(m: Column) -> dict[str, Column]:
    """Integer scores, so that cutoffs compare exactly; 0 where there is nothing to divide by."""

    def share(x: Column, by: Column, scale: int) -> Column:
        return F.when(by > 0, F.floor(x * scale / by)).otherwise(F.lit(0)).cast("long")

    return {"symbols": share(m["n_symbols"], m["n_words"], 1000), "dup_lines": share(m["n_dup_lines"], m["n_lines"], 1000), "repeats": share(m["n_repeat_words"], m["n_words"], 1000), "word_length": share(m["word_chars"], m["n_words"], 100)}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding; 1 for k above the mean, where no test passes."""
    log_choose = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    log_top = F.when(k > 0, log_choose).otherwise(F.lit(0.0)) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (1 - p) / p
    step = lambda a, i: F.struct((a["t"] * (k - i + 1) / (n - k + i) * ratio).alias("t"), (a["s"] + a["t"] * (k - i + 1) / (n - k + i) * ratio).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(log_top) * F.when(k > 0, tail).otherwise(F.lit(1.0)))


def fit(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cost: float = COST, cutoffs: dict[str, tuple[int, ...]] = CUTOFFS) -> DataFrame:
    """(stratum, <rule>...): the certified cutoff of each rule, null where none is; one row for each stratum that has any.

    `measured` has doc_id, stratum and m, the struct of `measures`; `labels` has doc_id and quality (1 is good). A document
    with several labels counts as good if one of them says so; null labels and ids are left out, as are documents that fail
    the base rules anyhow.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    held = measured.where(~base_failed(F.col("m"))).join(known, "doc_id")
    by_rule = [F.struct(F.lit(r).alias("rule"), sum((x > c).cast("int") for c in cutoffs[r]).alias("over")) for r, x in scores(F.col("m")).items()]
    # `over` of the cutoffs are exceeded: the strict end of the sequence first
    counts = held.select("stratum", "good", F.inline(F.array(*by_rule))).groupBy("stratum", "rule", "over").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    totals = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("over", "good", "bad")).alias("found"))
    grid = F.inline(F.array(*(F.struct(F.lit(r).alias("g_rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff")) for r, cs in cutoffs.items() for i, c in enumerate(cs))))
    # A score that exceeds j cutoffs exceeds the j strictest: the i-th most lenient of m falls when j >= m - i.
    size = F.element_at(F.create_map(*(F.lit(x) for r, cs in cutoffs.items() for x in (r, len(cs)))), F.col("rule"))

    def lost(what: str) -> Column:
        return F.aggregate(F.filter("found", lambda f: f["over"] >= size - F.col("i")), F.lit(0).cast("long"), lambda a, f: a + f[what])

    tests = totals.select("stratum", "rule", "n", "found", grid).where("rule = g_rule").select("stratum", "rule", "n", "i", "cutoff", lost("good").alias("k"), lost("bad").alias("caught"))
    strata = totals.agg(F.countDistinct("stratum").alias("strata"))
    level = delta / len(cutoffs)
    ordered = Window.partitionBy("stratum", "rule").orderBy("i")
    certified = (
        tests.join(F.broadcast(strata))
        .withColumn("ok", (binomial_cdf(F.col("k"), F.col("n"), risk / len(cutoffs)) * F.col("strata") <= level).cast("int"))
        .withColumn("ok", F.min("ok").over(ordered))
        .where((F.col("ok") == 1) & (F.col("caught") > F.col("k") * cost))
    )
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct((F.col("caught") - F.col("k") * cost).alias("gain"), F.col("cutoff").alias("lenient"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in cutoffs))


def judge(measured: DataFrame, cutoffs: DataFrame, rules: tuple[str, ...] = tuple(CUTOFFS)) -> DataFrame:
    """Adds base_failed and kept to rows that have stratum and m."""
    limits = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*rules).alias("_limits"))
    over = F.lit(False)
    for r, x in scores(F.col("m")).items():
        over = over | F.coalesce(x > F.col("_limits")[r], F.lit(False))
    out = measured.join(limits, F.col("stratum") == F.col("_stratum"), "left")
    return out.withColumns({"base_failed": base_failed(F.col("m")), "kept": ~base_failed(F.col("m")) & ~over}).drop("_stratum", "_limits")


def stratum_of(docs: DataFrame, column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in docs.columns else F.lit("")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each input row.

    Null and empty texts have no words and fail the base rules. Rows with a null doc_id are judged, but never labelled;
    rows that repeat a doc_id are judged one by one. A null stratum is one of its own. Other columns are ignored; empty
    tables give an empty result, an empty label table certifies no cutoff.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_of(docs, stratum).alias("stratum"), measures(F.col("text")).alias("m")))
    cutoffs = scratch.hold(fit(measured, labels, **options))
    out = judge(measured, scratch.maybe_broadcast(cutoffs))
    return out.select("doc_id", "stratum", *(F.col(f"m.{x}").alias(x) for x in BASE), "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options) -> DataFrame:
    """The rows of docs that pass, with their columns. Cutoffs come from the labelled documents; texts are not shuffled."""
    scratch = Scratch(docs.sparkSession)
    known = scratch.hold(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_of(docs, stratum).alias("stratum"), "text").join(scratch.maybe_broadcast(known.select("doc_id"), of=known), "doc_id", "left_semi")
    measured = scratch.hold(labelled.select("doc_id", "stratum", measures(F.col("text")).alias("m")))
    cutoffs = scratch.hold(fit(measured, known, **options))
    # a generator of one row: what stands above it reads its result, where a plain projection would be copied into the filter
    rows = docs.select(F.struct(*docs.columns).alias("row"), stratum_of(docs, stratum).alias("stratum"), F.inline(F.array(F.struct(measures(F.col("text")).alias("m")))))
    return judge(rows, scratch.maybe_broadcast(cutoffs)).where("kept").select("row.*")
