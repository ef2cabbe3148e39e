"""Token ids in files of compressed bit planes with a chunk index.

A file is a table of segments. A segment holds whole documents in ascending doc_id order, at least SEGMENT ids unless it
ends its shard, as one binary value:

    magic "BPL1" | ids in a block (u32) | blocks (u32) | ids (u64) | chunk index: for each block its planes (u8) and the
    byte length of each compressed plane (u32 each) | planes, compressed with zstandard, block after block

A block of fixed size is transposed into bit planes: plane b holds bit b of all its ids, eight to a byte, so that upper
planes are almost constant and compress well. Planes above the highest set bit are not stored. The segment's row also has
the ids and lengths of its documents, so any document can be read without the others' planes outside its blocks.

Segments are written by Spark's own committer, so a lost executor leaves no half-written file and any store will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, documents_of, map_chunks
from lumenark.llm.tokens import BATCH_BYTES, default_path, encoded_batch, widen

MAGIC, BLOCK, SEGMENT, LEVEL, SHARD_BYTES = b"BPL1", 1 << 14, 1 << 18, 3, 6 << 20
#: Boundaries between shards that are held at once.
RANGES = 4096
_HEAD = struct.Struct("<4sIIQ")


def encode_planes(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """One segment's ids as a binary value. No ids give a value without blocks."""
    packer = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], "<u4")
        planes = int(part.max()).bit_length()
        bits = np.unpackbits(_bytes(part, planes), axis=1, bitorder="little")[:, :planes]
        packed = [packer.compress(p.tobytes()) for p in np.packbits(np.ascontiguousarray(bits.T), axis=1)] if planes else []
        index.append(struct.pack(f"<B{planes}I", planes, *map(len, packed)))
        body += packed
    return b"".join([_HEAD.pack(MAGIC, block, len(index), len(ids)), *index, *body])


def _bytes(ids: np.ndarray, planes: int) -> np.ndarray:
    """The bytes of each id, as a row; two are enough for up to 16 planes."""
    return ids.astype("<u2").view(np.uint8).reshape(-1, 2) if planes <= 16 else ids.view(np.uint8).reshape(-1, 4)


def decode_planes(data: bytes) -> np.ndarray:
    """The ids of a segment. A value that is cut short or not of this format raises ValueError."""
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a bit-plane segment")
    _, block, blocks, n = _HEAD.unpack_from(data)
    at, lengths = _HEAD.size, []
    for _ in range(blocks):
        planes = data[at]
        lengths.append(struct.unpack_from(f"<{planes}I", data, at + 1))
        at += 1 + 4 * planes
    if at + sum(map(sum, lengths)) != len(data):
        raise ValueError("a bit-plane segment is cut short")
    unpacker, out = zstandard.ZstdDecompressor(), np.zeros(n, "<u4")
    for k, sizes in enumerate(lengths):
        part = out[k * block : (k + 1) * block]
        rows = []
        for size in sizes:
            rows.append(np.frombuffer(unpacker.decompress(data[at : at + size], max_output_size=(block + 7) // 8), np.uint8))
            at += size
        if rows:
            bits = np.unpackbits(np.stack(rows), axis=1, count=len(part)).T
            width = 16 if len(rows) <= 16 else 32
            wide = np.zeros((len(part), width), np.uint8)
            wide[:, : len(rows)] = bits
            part[:] = np.packbits(wide, axis=1, bitorder="little").view(f"<u{width // 8}").ravel()
    return out


def _segments(block: int, segment: int, level: int):
    """For a shard's documents: segments of whole documents, in ascending id order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable", na_position="first")
        out, held, n = [], [], 0

        def close():
            nonlocal held, n
            if held:
                out.append((int(rows["shard"].iloc[0]), len(out), n, [h[0] for h in held], [len(h[1]) for h in held], encode_planes(np.concatenate([h[1] for h in held]), block, level)))
            held, n = [], 0

        for doc_id, count, ids in zip(rows["doc_id"], rows["n_tokens"], rows["ids"], strict=True):
            held.append((None if pd.isna(doc_id) else int(doc_id), widen(ids, count)))
            n += count
            if n >= segment:
                close()
        close()
        return pd.DataFrame(out, columns=["shard", "segment", "n_ids", "doc_ids", "lengths", "planes"])

    return run


def shards_of(ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, part: int, least: int, most: int) -> np.ndarray:
    """The shard of each id, in the order of ids: its range between bounds, and which of `part` even steps of that range.

    least and most are those of the whole table, so that an id's shard does not depend on the rows beside it. Ids that are
    not known go to the first shard.
    """
    at = np.searchsorted(bounds, ids, "left")
    # Differences of signed longs can need all 64 bits.
    low = np.r_[np.int64(least), bounds][at].view(np.uint64)
    width = np.r_[bounds, np.int64(most)][at].view(np.uint64) - low
    step = (ids.view(np.uint64) - low) // (width // np.uint64(part) + np.uint64(1))
    return np.where(known, at.astype(np.int64) * part + step.astype(np.int64), 0)


SCHEMA = "shard int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, planes binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, segment: int = SEGMENT, level: int = LEVEL, shard_bytes: int = SHARD_BYTES, ranges: int = RANGES) -> None:
    """Encodes all texts, appends end_id to each, and writes segment files to `path`.

    Shards are ranges of doc_id with about shard_bytes of text each, so documents of one id meet in one shard; where that
    takes more than `ranges` of them, each range is dealt into even steps of doc_id. A null text
    has only the end id; null doc_ids come first; rows that repeat an id follow one another. An empty table writes an
    empty table.
    """
    docs = documents_of(docs, id_col, text_col)
    vocabulary = vocabulary or default_path()
    size, n, least, most = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    shards = max(1, min(-(-(size or 0) // shard_bytes), n or 1))
    # Boundaries between shards; approximate quantiles change only how even the shards are.
    ranges = min(shards, ranges)
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit([(i + 1) / ranges for i in range(ranges - 1)] or [1.0]), 100_000)).first()[0] or []
    bounds = np.unique(np.array(cuts[: ranges - 1], np.int64))
    part = -(-shards // ranges)
    tokens = encoded_batch(vocabulary, end_id)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = tokens(batch)
        doc_ids = out.column("doc_id")
        shard = shards_of(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), bounds, part, least or 0, most or 0)
        return out.append_column("shard", pa.array(shard, pa.int32()))

    encoded = map_chunks(docs, dealt, "doc_id long, n_tokens long, ids binary, shard int", limit=BATCH_BYTES)
    encoded.groupBy("shard").applyInPandas(_segments(block, segment, level), SCHEMA).write.option("compression", "none").mode("overwrite").parquet(path)


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, starts, lengths, crcs, shard, seg = [], [], [], [], [], []
    for s, k, doc_ids, sizes, planes in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "doc_ids", "lengths", "planes")), strict=True):
        data = decode_planes(planes).tobytes()
        at = 0
        for d, n in zip(doc_ids, sizes, strict=True):
            ids.append(d)
            starts.append(at)
            lengths.append(n)
            crcs.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
            shard.append(s)
            seg.append(k)
            at += n
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(seg, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids before it in all files."""
    shard = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # Two levels, so that no task holds more than a thousandth of the shards' totals and their sums.
    group = (F.col("shard") / 1024).cast("int")
    groups = shard.groupBy(group.alias("g")).agg(F.sum("n").alias("n"))
    before_group = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("g_start"))
    before = shard.withColumn("g", group).join(F.broadcast(before_group), "g").select("shard", (F.sum("n").over(Window.partitionBy("g").orderBy("shard")) - F.col("n") + F.col("g_start")).alias("s_start"))
    within = files.select("shard", "segment", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).alias("k_start"))
    places = within.join(before, "shard").select("shard", "segment", (F.col("k_start") + F.col("s_start")).alias("base"))
    rows = map_chunks(files.select("shard", "segment", "doc_ids", "lengths", "planes"), _read, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long", "planes")
    return rows.join(places, ["shard", "segment"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, **options) -> DataFrame:
    """Writes the files to the shared folder and returns what is read back from them."""
    scratch = Scratch(docs.sparkSession)
    path = f"{scratch.root}/token-files"
    write_token_files(docs, path, vocabulary, end_id, **options)
    return read_token_files(docs.sparkSession.read.schema(SCHEMA).parquet(path))
