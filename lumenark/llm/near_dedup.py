"""Near-duplicate documents: fast similarity sketches, banding, and exact confirmation on the full sets.

A sketch has t coordinates. Round i < t throws every element of a set into a hashed coordinate with a hashed value,
offset by i; round t + i sends all elements to coordinate i. Each coordinate keeps its least value, so that after at most
2t rounds every coordinate is filled, most sets being done after a few, and the share of equal coordinates of two sets
concentrates about their similarity.

Bands of four coordinates make buckets. With 40 bands a pair at similarity 0.75 shares no bucket with probability
(1 - 0.75**4)**40 = 2.5e-7. Inside a bucket members are first compared with one pivot a round, which joins most of a group by as many
comparisons as it has members. Pivot rounds go on while the pairs of members of different components are many against the
members. What is left in different components is then compared pair by pair: those outside a bucket's largest component with
all its members, and only where the sizes, the elements that stand in no other set, and the parity of the elements at each of
1024 places leave room for the similarity asked for; these bounds are exact and cost a few operations a pair. So every
link that could still join two components is tested on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, as_binary, digest, documents_of, gram_hashes, map_chunks, mix, word_hashes
from lumenark.llm.components import components

WIDTH, PERCENT, BANDS, ROWS = 5, 75, 40, 4
PARITY_WORDS = 16
#: Pivot rounds go on, up to PIVOTS, while a bucket's member has more than PAIRS pairs outside its component on average.
PIVOTS, PAIRS = 4, 16
#: A set with more than this share of all rows is joined to its copies by broadcast; there are fewer than 1 / HOT of them.
HOT = 1e-3
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words (A-Z lower-cased); of fewer words, one of the whole sequence."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) >= width:
        return np.unique(gram_hashes(h, width))
    return mix(gram_hashes(h, len(words)) + np.uint64(len(words)))


def sketches(elements: np.ndarray, lengths: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set; `elements` holds the sets one after another. An empty set stays unfilled."""
    n = len(lengths)
    out = np.full(n * t, _FULL, np.uint64)
    e, owner = elements, np.repeat(np.arange(n, dtype=np.int64), lengths)
    open_ = lengths > 0
    for i in range(2 * t):
        h = mix(e + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        done = open_ & (out.reshape(n, t) != _FULL).all(1)
        if done.any():
            open_ &= ~done
            if not open_.any():
                break
            left = open_[owner]
            e, owner = e[left], owner[left]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band; it depends on the band's place."""
    grouped = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
    for r in range(rows):
        h = mix(h * np.uint64(31) + grouped[:, :, r])
    return h


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of elements falls to each of 1024 places, as 16 longs.

    Two sets' bits differ in at most as many places as elements stand in only one of the sets.
    """
    odd = np.bincount(elements.view(np.uint64).astype(np.uint64) & np.uint64(64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1 if len(elements) else np.zeros(64 * PARITY_WORDS, np.int64)
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(bands: int, rows: int, width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, width) for x in as_binary(batch.column("text")).to_pylist()]
        lengths = np.array([len(s) for s in sets], np.int64)
        keys = band_keys(sketches(np.concatenate(sets) if sets else np.empty(0, np.uint64), lengths, bands * rows), bands, rows)
        marks = [digest(s.tobytes()) if len(s) else (None, None) for s in sets]
        flat = pa.array(keys.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lengths), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), lists],
            names=["doc_id", "n_shingles", "d1", "d2", "bands"],
        )

    return run


def _sets(width: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(x, width).view(np.int64) for x in as_binary(batch.column("text")).to_pylist()]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        words = np.concatenate([parities(s) for s in sets])
        marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(words))
        own = pa.array([digest(s.tobytes())[0] if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own, lists, marks], names=["id", "s", "elements", "parity"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("k"))
    return both.where(F.col("k") * 100 >= (F.col("n") + F.col("m") - F.col("k")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each input row.

    Documents are linked when their shingle sets have 100 * intersection >= percent * union; component_id is the least
    doc_id reachable, kept is true for that document.
    A null or empty text, or one without words, has n_shingles 0 and is linked with nothing. A null doc_id is never
    linked: component_id null, kept true. Rows that repeat a doc_id are one document with several texts: it is linked by
    each of them, and each row is reported.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = documents_of(docs, id_col, text_col)
    base = scratch.hold(map_chunks(docs, _describe(bands, rows, width), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), large=True)
    # Copies first: one node for each distinct set, its least doc_id. What copies share is aggregated before the shuffle.
    classes = scratch.keep(base.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    # Documents of several texts link the sets of these.
    several = base.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    tied = base.select("doc_id", "d1", "d2").join(several, "doc_id").join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    tied = scratch.keep(tied.distinct())
    keyed = classes.select("id", F.col("d1").alias("s"), "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = scratch.keep(keyed.join(shared, "key"))
    # The full sets of those that share any bucket.
    wanted = scratch.keep(members.select("id").distinct())
    sets = scratch.hold(map_chunks(docs.join(scratch.maybe_broadcast(wanted.withColumnRenamed("id", "doc_id"), of=wanted), "doc_id", "left_semi"), _sets(width), "id long, s long, elements array<long>, parity array<long>"), large=True)
    # An element that no other of these sets has can be in no intersection. What a set has besides such elements, `c`,
    # bounds its intersections, so most members of a bucket that are too far apart never become a pair.
    alone = sets.select(F.struct("id", "s").alias("o"), F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("k"), F.min("o").alias("o")).where("k = 1").groupBy("o.id", "o.s").agg(F.count("*").alias("u"))
    able = members.join(alone, ["id", "s"], "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0))).where(F.col("c") * 100 >= F.col("n") * percent).select("key", "id", "s", "n", "c")
    able = scratch.keep(able)
    members = scratch.keep(able.join(able.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "key"))
    linked = not tied.isEmpty()
    comp = components(tied, scratch) if linked else tied.selectExpr("a as node", "b as component")
    tested, turn = None, 0
    while True:
        if turn or linked:
            now = members.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "s", "n", "c", F.coalesce("component", "id").alias("comp"))
        else:
            now = members.withColumn("comp", F.col("id"))
        if turn:
            # Buckets that still hold more than one component, how many pairs they would give, and their largest component.
            sizes = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
            open_ = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("largest")).where("k > 1")
            open_ = scratch.keep(open_.select("key", (F.col("all") * F.col("all") - F.col("own")).alias("twice"), "all", F.col("largest.comp").alias("largest")))
            twice, rows_left = open_.agg(F.sum("twice"), F.sum("all")).first()
            if not twice:
                break
            # a bucket of one component stays so: later rounds read only the others
            members = scratch.keep(now.join(open_.select("key", "largest"), "key"))
            now = members
        last = turn > 0 and (twice <= 2 * PAIRS * rows_left or turn >= PIVOTS)
        if last:
            marked = scratch.hold(now.join(sets.select("id", "s", "parity"), ["id", "s"]))
            one, two = (marked.select("key", "largest", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "c", "comp", "parity"))) for s in "ab")
            # at least so many elements stand in only one of the two sets; the similarity allows but a share of both
            apart = sum(F.bit_count(F.get("parity_a", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(PARITY_WORDS))
            pairs = one.where("comp_a <> largest").join(two.drop("largest"), "key").where("comp_a <> comp_b and (id_a < id_b or comp_b = largest)").where(apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
            pairs = pairs.withColumns({"id_a": F.least("id_a", "id_b"), "id_b": F.greatest("id_a", "id_b")})
        else:
            order = F.col("id") if turn == 0 else F.xxhash64(F.lit(turn), "id")
            pivots = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "c", "comp")).alias("p"))
            pairs = now.join(pivots, "key").where("comp <> p.comp").select(F.least("id", "p.id").alias("id_a"), F.greatest("id", "p.id").alias("id_b"), F.col("n").alias("n_a"), F.col("p.n").alias("n_b"), F.col("c").alias("c_a"), F.col("p.c").alias("c_b"))
        # 100 * k >= percent * (n_a + n_b - k) for the largest intersection k there can be
        fits = F.least("c_a", "c_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
        pairs = pairs.where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        found = _confirmed(pairs, sets, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        comp = components(scratch.keep_compact(found.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))), scratch)
        turn += 1
        if last:
            break
    mapped = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", "copies", F.coalesce("component", "id").alias("c"))
    # A set that holds many rows would be one key of a shuffle: the few such sets go to all rows instead.
    mapped = scratch.keep(mapped)
    rows = base.select("doc_id", "n_shingles", "d1", "d2")
    most = (mapped.agg(F.sum("copies")).first()[0] or 0) * HOT
    hot = F.broadcast(mapped.where(F.col("copies") > most).drop("copies"))
    out = rows.join(hot, ["d1", "d2"]).unionByName(rows.join(hot, ["d1", "d2"], "left_anti").join(mapped.where(F.col("copies") <= most).drop("copies"), ["d1", "d2"], "left"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their columns. Rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.keep(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct())
    return docs.join(scratch.maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
