"""Repeated passages: Rabin-Karp hashes of every window of 20 words, counted in Spark, merged into removal intervals.

A window can only be repeated if the least-hashed 8-gram inside it, its anchor, is repeated too. So a first count over
the anchors alone (about one for seven words) says which windows can matter; the Rabin-Karp hashes of just those are then
counted. The windows of one anchor occurrence make a span; spans with equal content are settled together by the first
document that has them, and only the first of each content goes on window by window. Hashes are 61 bits of a Rabin-Karp
polynomial joined with the 64 bits of the anchor, so that a false repeat has a probability of about 2**-100 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, as_binary, chunks, digest, documents_of, gram_hashes, map_chunks, signed, word_hashes

WINDOW, ANCHOR = 20, 8
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_P61 = (1 << 61) - 1
#: An interval of window starts is one long: start * 2**20 + length, where a length is less than a window.
_LENGTH_BITS = 20
#: A row by its document and its text, so that rows that share a doc_id but not their text keep apart.
ROW = ["doc_id", "t"]


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("t", F.xxhash64("text"))


def split_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the place of its anchor (the first of the least 8-grams), and all 8-gram hashes."""
    grams = gram_hashes(words, anchor)
    span = window - anchor + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), grams
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return view.argmin(1) + np.arange(n), grams


def rabin_karp(words: np.ndarray, window: int, base: int = 0x1B873593CC9E2D51 % _P61) -> np.ndarray:
    """Polynomial hashes of all windows modulo 2**61 - 1.

    Hashes of runs of 1, 2, 4, ... words come by doubling, H(i, 2m) = H(i, m) * base**m + H(i + m, m); the binary digits
    of `window` say which of them make up its hash.
    """
    if len(words) < window:
        return np.empty(0, np.uint64)
    run = words >> np.uint64(3)
    run = np.where(run >= np.uint64(_P61), run - np.uint64(_P61), run)
    m, out, held = 1, None, 0
    while True:
        if window & m:
            # what is held so far covers the words after this run
            out = run.copy() if out is None else _add61(_mul61(run[: len(run) - held], pow(base, held, _P61))[: len(out) - m], out[m:])
            held += m
        if 2 * m > window:
            return out[: len(words) - window + 1]
        run = _add61(_mul61(run[:-m], pow(base, m, _P61)), run[m:])
        m *= 2


def _add61(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x + y
    return np.where(out >= np.uint64(_P61), out - np.uint64(_P61), out)


def _mul61(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2**61 - 1 on arrays, with 32-bit halves."""
    mask, p = np.uint64(0xFFFFFFFF), np.uint64(_P61)
    ch, cl = np.uint64(c >> 32), np.uint64(c & 0xFFFFFFFF)
    xh, xl = x >> np.uint64(32), x & mask
    low, mid, high = xl * cl, xl * ch + (xh * cl), xh * ch
    # 2**64 = 8 and 2**32 * y folds y's upper bits down
    out = (low & p) + (low >> np.uint64(61))
    out += (high << np.uint64(3)) & p
    out += high >> np.uint64(58)
    out += ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (mid >> np.uint64(29))
    out = (out & p) + (out >> np.uint64(61))
    return np.where(out >= p, out - p, out)


def _describe(window: int, anchor: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, marks, shas, keys, ends = [], [], [], [], [0]
        for text in as_binary(batch.column("text")).to_pylist():
            words = split_words(text)
            joined = b" ".join(words)
            counts.append(len(words))
            marks.append(digest(joined))
            shas.append(hashlib.sha256(joined).hexdigest())
            if len(words) >= window:
                at, grams = anchors(word_hashes(words), window, anchor)
                keys.append(grams[np.unique(at)])
            ends.append(ends[-1] + (len(keys[-1]) if len(words) >= window else 0))
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("t"), pa.array(counts, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["doc_id", "t", "n_words", "d1", "d2", "sha", "anchors"],
        )

    return run


def _spans(window: int, anchor: int):
    """Of each document with repeated anchors: its spans, and the windows that already stand earlier in it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "t", "k", "span", "at", "n", "windows")}
        held = 0

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["t"], pa.int64()), pa.array(rows["k"], pa.int64()), pa.array(rows["span"], pa.int64()), pa.array(rows["at"], pa.int32()), pa.array(rows["n"], pa.int32()), pa.array(rows["windows"], pa.list_(pa.int64()))],
                names=["doc_id", "t", "k", "span", "at", "n", "windows"],
            )
            for v in rows.values():
                v.clear()
            return out

        for doc_id, t, text, hits in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), as_binary(batch.column("text")).to_pylist(), batch.column("hits"), strict=True):
            h = word_hashes(split_words(text))
            at, grams = anchors(h, window, anchor)
            if not len(at):
                continue
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            stop = np.r_[start[1:], len(at)]
            keys = grams[at[start]].view(np.int64)
            full = rabin_karp(h, window)
            _, first, back = np.unique(full, return_index=True, return_inverse=True)
            again = first[back] != np.arange(len(full))  # the window stands earlier in this document
            for i in np.flatnonzero(np.isin(keys, hits.values.to_numpy())):
                a, b = int(start[i]), int(stop[i])
                own = again[a:b]
                if own.any():
                    for x, y in _runs(own):
                        _add(rows, doc_id, t, None, None, a + x, y - x, None)
                if not own.all():
                    part = full[a:b]
                    # equal content: the same windows, and the anchor at the same place in them
                    span = signed(xxhash.xxh3_64_intdigest(part.tobytes(), int(at[a]) - a))
                    _add(rows, doc_id, t, int(keys[i]), span, a, b - a, part.view(np.int64).tolist())
                held += 1
                if held >= 20_000:
                    yield flush()
                    held = 0
        yield flush()

    return run


def _add(rows: dict[str, list], *values) -> None:
    for k, v in zip(rows, values, strict=True):
        rows[k].append(v)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(n: int, cuts: list[int], window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the intervals; each is its start and, in the low bits, length."""
    change = np.zeros(n + 1, np.int64)
    packed = np.asarray(cuts, np.int64)
    a = packed >> _LENGTH_BITS
    b = np.minimum(a + (packed & ((1 << _LENGTH_BITS) - 1)) + window - 1, n)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    return np.cumsum(change[:n]) > 0


def _cut(window: int):
    """Applies the intervals of each document to its words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, shas, texts = [], [], []
        for text, cuts, all_ in zip(as_binary(batch.column("text")).to_pylist(), batch.column("cuts").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            words = split_words(text)
            if all_:
                removed.append(len(words))
                texts.append(b"")
            elif cuts:
                gone = covered(len(words), cuts, window)
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            else:
                removed.append(0)
                texts.append(b" ".join(words))
            shas.append(hashlib.sha256(texts[-1]).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(split_words(t)) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "left", "n_removed", "kept_sha256", "kept_text"])

    return run


def removal_intervals(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(table of rows with n_words and the hash of their words; table of doc_id, t, gone, cuts), of docs with the mark t.

    `cuts` lists packed intervals of window starts to remove; `gone` marks whole copies of an earlier document. Only rows
    that lose a word are in it, by doc_id and text. Rows that repeat a doc_id remove nothing from each other; rows
    with a null doc_id neither lose words nor cause it.
    """
    base = scratch.keep(map_chunks(docs, _describe(window, anchor), "doc_id long, t long, n_words long, d1 long, d2 long, sha string, anchors array<long>"))
    long_ = base.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long_.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    copied = first.where("c > 1").select("d1", "d2", "first")
    copies = scratch.hold(long_.select(*ROW, "d1", "d2").join(copied, ["d1", "d2"]).where("doc_id <> first").select(*ROW).distinct())
    occurrences = long_.select(*ROW, "anchors").join(scratch.maybe_broadcast(copies), ROW, "left_anti").select(*ROW, F.explode("anchors").alias("k"))
    repeated = scratch.hold(occurrences.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"))
    hits = scratch.keep(occurrences.join(repeated, "k").groupBy(*ROW).agg(F.collect_set("k").alias("hits")))
    spans = scratch.keep(map_chunks(docs.join(scratch.maybe_broadcast(hits), ROW), _spans(window, anchor), "doc_id long, t long, k long, span long, at int, n int, windows array<long>"))
    own = spans.where("k is null").select(*ROW, "at", "n")
    cross = spans.where("k is not null")
    settled = scratch.hold(cross.groupBy("k", "span").agg(F.min("doc_id").alias("first")))
    judged = cross.join(settled, ["k", "span"])
    later = judged.where("doc_id <> first").select(*ROW, "at", "n")
    single = scratch.hold(judged.where("doc_id = first").select(*ROW, "k", F.posexplode("windows").alias("i", "w"), "at").select("k", "w", *ROW, (F.col("at") + F.col("i")).alias("at")))
    earliest = scratch.hold(single.groupBy("k", "w").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("k", "w", "first"))
    windows = single.join(earliest, ["k", "w"]).where("doc_id <> first").select(*ROW, "at", F.lit(1).alias("n"))
    cuts = own.unionByName(later).unionByName(windows).groupBy(*ROW).agg(F.collect_list(F.col("at").cast("long") * (1 << _LENGTH_BITS) + F.col("n")).alias("cuts"))
    empty = F.array().cast("array<bigint>")
    plan = cuts.select(*ROW, F.lit(False).alias("gone"), "cuts").unionByName(copies.select(*ROW, F.lit(True).alias("gone"), empty.alias("cuts")))
    return base, scratch.keep(plan.groupBy(*ROW).agg(F.max("gone").alias("gone"), F.flatten(F.collect_list("cuts")).alias("cuts")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): one row for each input row.

    Every word covered by a window of `window` words whose words also start earlier (smaller doc_id, or earlier in the
    same document) is removed, judged on the input. kept_text is the words left, joined by one space.
    A null or empty text has no words; a text shorter than a window loses nothing; null and repeated ids as in
    removal_intervals. Other columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = _marked(documents_of(docs, id_col, text_col))
    base, plan = removal_intervals(docs, scratch, window, anchor)
    if with_text:
        cut = map_chunks(docs.join(scratch.maybe_broadcast(plan), ROW, "left"), _cut(window), "doc_id long, left long, n_removed long, kept_sha256 string, kept_text string")
        return cut.select("doc_id", (F.col("left") + F.col("n_removed")).alias("n_words"), "n_removed", "kept_sha256", "kept_text")
    # Untouched documents and whole copies need no second look at their text.
    changed = map_chunks(docs.join(scratch.maybe_broadcast(plan.where("not gone"), of=plan), ROW), _cut(window), "doc_id long, left long, n_removed long, kept_sha256 string, kept_text string")
    partly = changed.select("doc_id", (F.col("left") + F.col("n_removed")).alias("n_words"), "n_removed", "kept_sha256")
    marks = plan.select(*ROW, "gone")
    rest = base.select(*ROW, "n_words", "sha").join(scratch.maybe_broadcast(marks, of=plan), ROW, "left").where("gone is null or gone")
    rest = rest.select("doc_id", "n_words", F.when(F.col("gone"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone"), F.lit(_EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"))
    return rest.unionByName(partly)


def _rewrite(names: list[str], window: int):
    """Replaces the text of rows that have cuts, and its length where a column n_chars has it; other rows pass as they are."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                text = part.column("text").to_pylist()
                cuts, gone = part.column("_cuts").to_pylist(), part.column("_gone").to_pylist()
                chars = part.column("n_chars").to_pylist() if "n_chars" in names else None
                for i, (c, g) in enumerate(zip(cuts, gone, strict=True)):
                    if not (c or g):
                        continue
                    words = text[i].encode().split()
                    lost = covered(len(words), c, window).tolist() if not g else [True] * len(words)
                    text[i] = b" ".join([w for w, x in zip(words, lost, strict=True) if not x]).decode()
                    if chars is not None:
                        chars[i] = len(text[i])
                new = {"text": pa.array(text, part.schema.field("text").type)}
                if chars is not None:
                    new["n_chars"] = pa.array(chars, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in names], names=names)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of docs with repeated passages cut from their texts and n_chars, if there is one, set to the new length.

    Texts that lose nothing keep their white space; of the others the words left are joined by one space. A document that
    loses all its words stays, with an empty text.
    """
    scratch = Scratch(docs.sparkSession)
    _, plan = removal_intervals(_marked(documents_of(docs)), scratch, window, anchor)
    marks = plan.select("doc_id", F.col("t").alias("_t"), F.col("gone").alias("_gone"), F.col("cuts").alias("_cuts"))
    joined = docs.withColumn("_t", F.xxhash64("text")).join(scratch.maybe_broadcast(marks, of=plan), ["doc_id", "_t"], "left").select(*docs.columns, "_gone", "_cuts")
    return joined.mapInArrow(_rewrite(docs.columns, window), docs.schema)
