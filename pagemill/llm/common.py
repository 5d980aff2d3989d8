"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the word pattern; ``bytes.split()`` cuts at the same six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Only a local master may go without it: then a temporary folder is made and set.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; the shared folder's owner clears it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    return next(n for n in (f"{base}_{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)


def text_key(text: str = "text") -> Column:
    """A hash that, with doc_id, names a row of documents; null text as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key() -> list[Column]:
    """doc_id and text_key of a row of documents, as (doc_id, key) tables name it."""
    return [F.col("doc_id"), text_key()]


def same_row(docs: str, keys: str) -> Column:
    """Documents under one alias are those of a (doc_id, key) table under another; null ids match."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{keys}.doc_id")) & (text_key(f"{docs}.text") == F.col(f"{keys}.key"))


#: 64-bit words of a key filter at most: 2**26 bits, 32 MB broadcast, whatever the number of keys.
FILTER_WORDS = 1 << 20


def _filter_bits(h: Column) -> tuple[Column, Column]:
    """The word of a filter that a hash belongs to, and its three bits there."""
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (20, 27, 34)]
    return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2])


def split_by_keys(rows: DataFrame, keys: DataFrame, of_rows: list[Column], of_keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows whose key is surely none of keys, and all others, by a Bloom filter of fixed size.

    The filter is a table of at most FILTER_WORDS rows and is broadcast, so the first part needs no shuffle to meet
    keys; the second, with a few rows too many, must meet them exactly. The plan is the same for any number of keys.
    """
    word, bits = _filter_bits(F.xxhash64(*of_keys))
    known = staged(keys.select(word.alias("w"), bits.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")), "key-filter")
    word, bits = _filter_bits(F.xxhash64(*of_rows))
    w, b, m = (free_name(rows, n) for n in ("word", "bits", "wanted"))
    met = rows.withColumns({w: word, m: bits}).join(F.broadcast(known.select(F.col("w").alias(w), F.col("b").alias(b))), w, "left")
    hit = F.coalesce(F.col(b).bitwiseAND(F.col(m)) == F.col(m), F.lit(False))
    return met.where(~hit).select(*[F.col(f"`{c}`") for c in rows.columns]), met.where(hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def byte_slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each slice hold about ``limit`` bytes (a longer text stands alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size, dtype=np.int64) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def utf8_list(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts in order: how many each text has, each word's code, and the word of each code."""
    split = [t.split() for t in texts]
    count = np.fromiter((len(w) for w in split), np.int64, len(split))
    flat = np.empty(int(count.sum()), dtype=object)
    at = 0
    for w in split:
        flat[at : at + len(w)] = w
        at += len(w)
    codes, words = pd.factorize(flat)
    return count, codes.astype(np.int64), list(words)
