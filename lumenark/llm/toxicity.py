"""Toxic severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(cut_k - w . x) with one weight vector for all ordered cuts; the expected severity is the sum over
k of P(grade > k). Features are the distinct words of a text (lower case, ASCII punctuation apart) and their first STEM bytes,
hashed to 2**20 places; those whose counts tell the grades apart are kept. The model is fitted on a bounded sample of labelled documents
(SAMPLE rows, chosen by a hash of the id), on the driver; scoring is one pass over all texts.

The labels say only whether a text is toxic. Toxic texts are graded by the share of their words that mark toxic texts in
the sample: below the first tercile 1, below the second 2, else 3. Grades in a column grade of the label table go before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, as_binary, documents_of, map_chunks, word_hashes

#: Labelled rows for the fit, half of them toxic where there are so many; feature places; features kept; grades above 0.
SAMPLE, BITS, FEATURES, GRADES, STEM = 16_000, 20, 4096, 3, 5
_APART = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_APART).split() if text else []


def places(words: list[bytes]) -> np.ndarray:
    """Places of the distinct words, and of the beginnings of the longer ones, which stand for their stems."""
    distinct = set(words)
    stems = {b"^" + w[:STEM] for w in distinct if len(w) > STEM}
    return (word_hashes([*distinct, *stems]) >> np.uint64(64 - BITS)).astype(np.int64)


def places_of_each(words: list[bytes]) -> np.ndarray:
    """As places, for every occurrence."""
    return (word_hashes([*words, *(b"^" + w[:STEM] for w in words if len(w) > STEM)]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """slot: for each hashed place the kept feature or -1; weights; ordered cuts."""

    slot: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, from w . x."""
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))

    def score(self, words: list[bytes]) -> float:
        if not words:
            return 0.0
        kept = self.slot[places(words)]
        kept = np.unique(kept[kept >= 0])
        return float(self.weights[kept].sum())


def marking(table: DataFrame, toxic: int, other: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The places whose presence differs most between toxic and other texts (z of the log odds), and their log odds.

    Counted in Spark; `features` rows at most come back.
    """
    c1, c0 = F.col("c1") + 0.5, F.col("c0") + 0.5
    r1, r0 = F.lit(toxic + 1.0) - c1, F.lit(other + 1.0) - c0
    counted = table.select("toxic", F.explode("places").alias("p")).groupBy("p").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("c1"), F.sum((F.col("toxic") <= 0).cast("long")).alias("c0")).where("c1 + c0 >= 5")
    odds = counted.select("p", (F.log(c1 / r1) - F.log(c0 / r0)).alias("odds"), F.sqrt(1 / c1 + 1 / r1 + 1 / c0 + 1 / r0).alias("error")).withColumn("z", F.abs(F.col("odds") / F.col("error")))
    best = odds.where("z > 2.5").orderBy(F.desc("z"), "p").limit(features).select("p", "odds").collect()
    return np.array([r.p for r in best], np.int64), np.array([r.odds for r in best], float)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_cuts: int, rounds: int = 500, rate: float = 0.05, l2: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by Adam on the mean negative log likelihood; cuts stay ordered as a first cut and positive steps."""
    n = len(grades)
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(n_cuts)])
    cut0 = -np.log(share / (1 - share))
    theta = np.r_[np.zeros(n_features), cut0[0], np.log(np.maximum(np.diff(cut0), 1e-2))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    index = np.arange(n)
    for step in range(1, rounds + 1):
        w, cuts = theta[:n_features], np.cumsum(np.r_[theta[n_features], np.exp(theta[n_features + 1 :])])
        s = np.bincount(rows, w[cols], minlength=n)
        below = np.c_[np.zeros(n), 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -40, 40))), np.ones(n)]
        p = np.maximum(below[index, grades + 1] - below[index, grades], 1e-12)
        slope = below * (1 - below)
        hi, lo = slope[index, grades + 1] / p, slope[index, grades] / p
        ds = (hi - lo) / n  # of -log p with respect to s
        dcut = np.array([(np.where(grades == k + 1, lo, 0) - np.where(grades == k, hi, 0)).sum() / n for k in range(n_cuts)])
        tail = np.cumsum(dcut[::-1])[::-1]
        g = np.r_[np.bincount(cols, ds[rows], minlength=n_features) + l2 * w, tail[0], tail[1:] * np.exp(theta[n_features + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:n_features], np.cumsum(np.r_[theta[n_features], np.exp(theta[n_features + 1 :])])


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets, counts, totals = [], [], []
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        p = np.unique(places(words))
        sets.append(p.astype(np.int32))
        # how often the word or stem at each place occurs
        counts.append(np.bincount(np.searchsorted(p, places_of_each(words)), minlength=len(p)).astype(np.int32))
        totals.append(len(words))
    ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("toxic"), batch.column("grade"), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))],
        names=["toxic", "grade", "n", "places", "counts"],
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> Model | None:
    """The model of a bounded sample; None if it lacks toxic or other documents. Null labels and ids are left out; a
    document with several labels takes the highest."""
    scratch = Scratch(docs.sparkSession)
    grade = F.max(F.col("grade").cast("int")) if "grade" in labels.columns else F.lit(None).cast("int")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), grade.alias("grade"))
    order = F.xxhash64("doc_id")
    some = known.where("toxic > 0").orderBy(order, "doc_id").limit(sample // 2).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(sample - sample // 2))
    some = scratch.keep_compact(some)
    found = map_chunks(documents_of(docs).join(scratch.maybe_broadcast(some), "doc_id").select("text", "toxic", "grade"), _features, "toxic int, grade int, n long, places array<int>, counts array<int>")
    table = scratch.hold(found)
    n, toxic = table.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("long"))).first()
    if not toxic or toxic == n:
        return None
    best, odds = marking(table, toxic, n - toxic)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[best] = np.arange(len(best))
    # of each text only the kept features leave the executors
    rows = table.mapInArrow(_kept(best, odds), "toxic int, grade int, density double, kept array<int>").toArrow()
    scratch.drop(table)
    toxic = rows.column("toxic").to_numpy() > 0
    density = rows.column("density").to_numpy()
    limits = np.quantile(density[toxic], [(k + 1) / grades for k in range(grades - 1)])
    y = np.where(toxic, 1 + np.searchsorted(limits, density, "right"), 0)
    given = rows.column("grade").to_pandas().to_numpy(float)
    y = np.where(np.isnan(given), y, np.clip(np.nan_to_num(given), 0, grades)).astype(np.int64)
    lists = pa.concat_arrays(rows.column("kept").chunks)
    index = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    weights, cuts = fit_ordinal(index, lists.flatten().to_numpy().astype(np.int64), y, max(len(best), 1), grades)
    return Model(slot, weights, cuts)


def _kept(best: np.ndarray, odds: np.ndarray):
    """Of each text its kept features, and how many of its words and stems have positive log odds, by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[best] = np.arange(len(best))
        for batch in batches:
            ends, density, lists = [0], [], []
            for places_, counts, n in zip(batch.column("places"), batch.column("counts"), batch.column("n").to_pylist(), strict=True):
                at = slot[places_.values.to_numpy()]
                known = at >= 0
                lists.append(at[known])
                ends.append(ends[-1] + len(lists[-1]))
                density.append(float(counts.values.to_numpy()[known][odds[lists[-1]] > 0].sum()) / max(n, 1) if len(lists[-1]) else 0.0)
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("grade"), pa.array(density, pa.float64()), kept], names=["toxic", "grade", "density", "kept"])

    return run


def _scored(model: Model):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.array([model.score(words_of(t)) for t in batch.column("text").to_pylist()], float)
        above = model.above(score).round(6)
        grade = np.c_[np.ones(len(score)), above] - np.c_[above, np.zeros(len(score))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(1).round(6)), pa.array(grade.argmax(1).astype(np.int64)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], names=["doc_id", "expected_severity", "severity", "p_toxic", "toxic"])

    return run


RESULT = "doc_id long, expected_severity double, severity long, p_toxic double, toxic boolean"


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> DataFrame:
    """(doc_id, expected_severity, severity, p_toxic, toxic) of each document: severity is the likeliest grade.

    Null and empty texts have no features and score by the cuts alone. Null and repeated ids are scored row by row. Without
    a model (no toxic or no other labels) all is 0 and false. Other columns are ignored; no documents give no rows.
    """
    model = fit(docs, labels, sample, grades)
    docs = documents_of(docs)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).cast("long").alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    return map_chunks(docs, _scored(model), RESULT)
