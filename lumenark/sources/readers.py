"""Readers of the formats the library's data comes in. Files go through Spark's readers, so any store will do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def idx_images(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """(file, id, rows, cols, pixels) of big-endian image files: magic, count, height, width, then one byte a pixel."""

    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                _, n, rows, cols = np.frombuffer(data, ">u4", 4)
                x = np.frombuffer(data, np.uint8, offset=16).reshape(n, -1).astype(float) / (255.0 if normalize else 1.0)
                for at in range(0, int(n), 1024):
                    part = x[at : at + 1024]
                    yield pd.DataFrame({"file": file, "id": np.arange(at, at + len(part)), "rows": int(rows), "cols": int(cols), "pixels": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id long, rows int, cols int, pixels array<double>")


def idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, label): magic, count, then one byte a label."""

    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                x = np.frombuffer(data, np.uint8, offset=8)
                yield pd.DataFrame({"file": file, "id": np.arange(len(x)), "label": x.astype(int)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id long, label int")


def corpus_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, word) of text files: a line break is the mark <eos>, words split at white space."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    words = F.filter(F.split(F.regexp_replace("value", "\n", "<eos>"), "\\s+"), lambda w: w != "")
    return text.select("file", F.posexplode(words).alias("pos", "word"))


def digit_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """(file, digit, bits) of files of 0 and 1 in lines; the digit is the name's first part."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    bits = F.transform(F.filter(F.split(F.regexp_replace("value", "[^01]", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return text.select("file", F.regexp_extract("file", "([0-9]+)_[0-9]+[^/]*$", 1).cast("int").alias("digit"), bits.alias("bits"))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = False, missing: str = "NA") -> DataFrame:
    """Delimited text with a given schema; the missing mark and blank lines are left out as nulls and rows."""
    return spark.read.csv(path, schema=schema, sep=separator, header=header, nullValue=missing, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).dropna("all")


def fixed_width_pairs(spark: SparkSession, path: str, at: int = 7) -> DataFrame:
    """(question, answer): lines cut at a place."""
    return spark.read.text(path).select(F.substring("value", 1, at).alias("question"), F.expr(f"substring(value, {at + 1})").alias("answer"))


def numpy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values) of .npy files of one or two dimensions."""

    def run(batches):
        import io

        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                x = np.load(io.BytesIO(data), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(float)
                yield pd.DataFrame({"file": file, "row": np.arange(len(x)), "values": list(x)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, values array<double>")


def impute_and_encode(df: DataFrame, numeric: list[str], categorical: dict[str, list[str]]) -> DataFrame:
    """Numbers z-scored by their sample deviation with nulls as 0; categories as 0/1 columns with one for null."""
    stats = df.agg(*(F.avg(c).alias(f"{c}_m") for c in numeric), *(F.stddev_samp(c).alias(f"{c}_s") for c in numeric))
    wide = df.join(F.broadcast(stats))
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")), F.lit(0.0)).alias(c) for c in numeric]
    dummies = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, vs in categorical.items() for v in vs]
    missing = [F.col(c).isNull().cast("int").alias(f"{c}_null") for c in categorical]
    rest = [c for c in df.columns if c not in numeric and c not in categorical]
    return wide.select(*rest, *scaled, *dummies, *missing)
