"""Packing documents into fixed windows at target source proportions, by deficit round-robin.

Documents are dealt into buckets of about BUCKET_TOKENS tokens by hash, whatever their source, so that a source with a
third of all rows is spread evenly. Inside a bucket every source is a queue. Each window credits every source with its
share of the window; sources are visited in turn and take what their credit (deficit counter) allows, once it allows a
piece of MIN_PIECE tokens or the rest of a document; room left over goes to the sources with most credit, which then owe.
What a source is owed goes on to the next window, and from bucket to bucket: a bucket uses up all its documents, so what
it leaves owed is known from totals alone, and all buckets can be filled at the same time.

The last window of a bucket is split into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, map_chunks
from lumenark.llm.tokens import BATCH_BYTES, default_path, encoded_batch, widen

WINDOW, BUCKET_TOKENS, MIN_PIECE = 2048, 1 << 20, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def window_sizes(total: int, window: int) -> list[int]:
    """Whole windows, then powers of two for what is left."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def fill(queues: dict[str, deque], shares: dict[str, float], owed: dict[str, float], sizes: list[int], min_piece: int) -> list[tuple]:
    """(source, document, start, length, window, offset) of each piece. A queue holds [document, tokens left, start]."""
    ring = deque(sorted(queues))
    left = {s: sum(d[1] for d in q) for s, q in queues.items()}
    credit = {s: owed.get(s, 0.0) for s in ring}
    out = []

    def take(source: str, most: int, window: int, offset: int) -> int:
        """Pieces from the head of a queue; at most `most` tokens."""
        taken = 0
        queue = queues[source]
        while taken < most and queue:
            head = queue[0]
            n = min(head[1], most - taken)
            out.append((source, head[0], head[2], n, window, offset + taken))
            taken += n
            head[1] -= n
            head[2] += n
            if not head[1]:
                queue.popleft()
        credit[source] -= taken
        left[source] -= taken
        return taken

    for window, size in enumerate(sizes):
        active = sum(shares[s] for s in ring) or 1.0
        for s in ring:
            credit[s] += size * shares[s] / active
        room = size
        for _ in range(len(ring)):
            if not room:
                break
            s = ring[0]
            ring.rotate(-1)
            ready = min(min_piece, queues[s][0][1], room) if left[s] else 0
            if left[s] and credit[s] >= ready:
                room -= take(s, min(int(max(credit[s], ready)), room), window, size - room)
        while room:
            s = max((s for s in ring if left[s]), key=lambda s: (credit[s], s))
            room -= take(s, min(room, max(min_piece, int(credit[s])), left[s]), window, size - room)
        if any(not left[s] for s in ring):
            ring = deque(s for s in ring if left[s])
    return out


def _packed(window: int, min_piece: int, with_ids: bool):
    def run(docs: pa.Table, carry: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("order", "ascending"), ("doc_id", "ascending")]))
        names, sources, sizes = docs.column("doc_id").to_pylist(), docs.column("source").to_pylist(), docs.column("n_tokens").to_pylist()
        queues: dict[str, deque] = {}
        for i, (s, n) in enumerate(zip(sources, sizes, strict=True)):
            queues.setdefault(s, deque()).append([i, n, 0])
        known = carry.column("source").to_pylist()
        shares = dict(zip(known, carry.column("share").to_pylist(), strict=True))
        owed = dict(zip(known, carry.column("owed").to_pylist(), strict=True))
        pieces = fill(queues, shares, owed, window_sizes(sum(sizes), window), min_piece)
        ids = [widen(x, n).tobytes() for x, n in zip(docs.column("ids").to_pylist(), sizes, strict=True)]
        first = docs.column("bucket")[0].as_py() << 24 if len(names) else 0
        raw = [ids[d][4 * a : 4 * (a + n)] for _, d, a, n, _, _ in pieces]
        columns = {
            "doc_id": [names[p[1]] for p in pieces],
            "start": [p[2] for p in pieces],
            "length": [p[3] for p in pieces],
            "ids_crc32": [zlib.crc32(x) for x in raw],
            "doc_tokens": [sizes[p[1]] for p in pieces],
            "sequence_id": [first + p[4] for p in pieces],
            "offset": [p[5] for p in pieces],
        }
        out = {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"source": pa.array([p[0] for p in pieces], pa.string())}
        return pa.table(out | {"ids": pa.array(raw, pa.binary())} if with_ids else out)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_tokens: int = BUCKET_TOKENS, min_piece: int = MIN_PIECE, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids].

    A document's ids are its text's with end_id appended; every id is in exactly one piece; a sequence's pieces are gapless
    from offset 0. Targets are `weights` by source, or else each source's share of all tokens; a source without a weight
    counts as weight 0 and fills only what the others leave. A source that has run out in a bucket leaves its share to the rest.
    A null text has only the end id; a null source (or a missing column) is the source ''; null and repeated ids are
    packed row by row. Other columns are ignored; an empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).alias("text"))
    encoded = scratch.hold(map_chunks(chosen, encoded_batch(vocabulary or default_path(), end_id), "doc_id long, source string, n_tokens long, ids binary", limit=BATCH_BYTES), large=True)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    order = F.xxhash64("doc_id", "source", F.crc32("ids"))
    dealt = encoded.withColumns({"order": order, "bucket": F.pmod(order, F.lit(buckets))})
    held = scratch.hold(dealt.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("n")))
    shares = held.groupBy("source").agg((F.sum("n") / max(total, 1)).alias("share"))
    if weights is not None:
        listed = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,double>")
        shares = shares.select("source", F.coalesce(listed[F.col("source")].cast("double") / (sum(weights.values()) or 1.0), F.lit(0.0)).alias("share"))
    # What each source is owed before a bucket: its share of all tokens in earlier buckets, less what these held of it.
    every = held.groupBy("bucket").agg(F.sum("n").alias("all"))
    block = F.floor(F.col("bucket") / 1024)
    blocks = every.groupBy(block.alias("block")).agg(F.sum("all").alias("b"))
    earlier = blocks.select("block", (F.sum("b").over(Window.orderBy("block")) - F.col("b")).alias("b"))
    before = every.withColumn("block", block).join(F.broadcast(earlier), "block").select("bucket", (F.sum("all").over(Window.partitionBy("block").orderBy("bucket")) - F.col("all") + F.col("b")).alias("before"))
    own = held.select("bucket", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("own"))
    carry = own.join(before, "bucket").join(shares, "source").select(F.col("bucket").alias("bucket"), F.col("source").alias("source"), "share", (F.col("share") * F.col("before") - F.col("own")).alias("owed"))
    schema = PIECES + (", ids binary" if with_ids else "")
    return dealt.groupBy("bucket").cogroup(carry.groupBy("bucket")).applyInArrow(_packed(window, min_piece, with_ids), schema)
