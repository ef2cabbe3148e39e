"""What the corpus operators share: words, hashes, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer document is still handled whole.
CHUNK_BYTES = 4 << 20
#: A side is broadcast only if it was measured to hold at most so many bytes in memory, with so many bytes a row beside its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 40

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive words, by a polynomial modulo 2**64 over the word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _K
        out += h[j : j + n]
    return mix(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digest(data: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    d = xxhash.xxh3_128_intdigest(data)
    return signed(d >> 64), signed(d & 0xFFFFFFFFFFFFFFFF)


def as_binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes in one column, one row at least."""
    sizes = as_binary(batch.column(column))
    at, held = 0, 0
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]) if len(sizes) else []
    for i, n in enumerate(lengths):
        if i > at and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def map_chunks(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column, limit):
                out = f(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()  # workers are used again, and what a pool keeps counts as theirs

    return df.mapInArrow(run, schema)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset, as in tests, a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lumenark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Results that several steps need. What loops pass on is written to the shared folder, which cuts lineage; what is
    one step from the input is held by the executors, and a part lost with one of them is computed again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/lumenark-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Writes df and reads it again; cuts lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumenark_path = path
        return out

    def keep_compact(self, df: DataFrame) -> DataFrame:
        """As keep, in one job and few files: adaptive execution sizes them. For tables of loops, of unknown size."""
        return self.keep(df.hint("rebalance"))

    def hold(self, df: DataFrame, large: bool = False) -> DataFrame:
        """df, computed once when an action first runs over it: in memory and beyond it on disk, or, if large, on disk only.

        A part that is lost with its executor is computed again from its own input. Not for loops: plans would nest.
        """
        return df.persist(StorageLevel.DISK_ONLY if large else StorageLevel.MEMORY_AND_DISK)

    def drop(self, df: DataFrame) -> None:
        """Gives up a table that no later step reads."""
        if hasattr(df, "_lumenark_path"):
            delete(self.spark, df._lumenark_path)
        else:
            df.unpersist()

    def bytes(self, df: DataFrame) -> int:
        """Measured size in memory as rows of a hash table: its fixed columns, what its lists and texts hold, and ROW_BYTES a row."""
        held = [F.lit(0).cast("long")]
        for name, kind in df.dtypes:
            held += [F.coalesce(F.size(name) * 8, F.lit(0)) for _ in "a" if kind.startswith("array")]
            held += [F.coalesce(F.octet_length(name), F.lit(0)) for _ in "a" if kind in ("string", "binary")]
        n, varying = df.agg(F.count("*"), F.sum(sum(held[1:], held[0]))).first()
        return n * (ROW_BYTES + 8 * len(df.columns)) + (varying or 0)

    def maybe_broadcast(self, df: DataFrame, limit: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
        """df, marked for broadcast only if its size, or that of the table it comes from, is within the limit.

        Beyond it the join shuffles both sides.
        """
        return F.broadcast(df) if self.bytes(df if of is None else of) <= limit else df


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column's name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
