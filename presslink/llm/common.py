"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches of bounded size; numpy works on the raw UTF-8
buffers. Tables that a job reads more than once are written to the shared folder
named by ``spark.checkpoint.dir`` and read again, so a lost executor costs a task.
"""

from __future__ import annotations

import atexit
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.session import ensure_checkpoint_dir

#: Word separators of the documents' contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A key with more rows than this is heavy: its rows are dealt over several tasks.
HEAVY_ROWS = 5_000

BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry texts: at most 500 rows or 16 MB each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again (cuts lineage, survives executors)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, other: DataFrame, key: str, how: str = "left", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Join ``df`` to ``other`` (one row per ``key``) with the rows of heavy keys dealt over many tasks.

    The heavy keys are those with more than ``heavy_rows`` rows and more than a thousandth of all rows
    of ``df``, hence fewer than 1,000: that list is broadcast. ``other``'s row of such a key is repeated
    once per share. ``df`` is read twice: pass something cheap to read again.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    limit = max(heavy_rows, total // 1000)
    heavy = (counts.where(F.col("_n") > limit)
             .select(F.col(key).alias("_hk"), F.ceil(F.col("_n") / limit).cast("int").alias("_shares")))
    heavy = df.sparkSession.createDataFrame(heavy.collect(), heavy.schema)   # fewer than 1,000 rows
    if heavy.isEmpty():
        return df.join(other, key, how)
    left = (df.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
            .withColumn("_share", F.coalesce(F.floor(F.rand(7) * F.col("_shares")).cast("int"), F.lit(0)))
            .drop("_hk", "_shares"))
    right = (other.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
             .withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)))
             .drop("_hk", "_shares"))
    return left.join(right, [key, "_share"], how).drop("_share")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[at:at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole texts (first, last + 1) of about ``most`` bytes each; a longer text is a run of its own."""
    out, start = [], 0
    n = len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte value.
BYTE_CODE = mix((np.arange(1, 257, dtype=np.uint64)) * _P)


def _powers(base: int, n: int) -> np.ndarray:
    if n <= KEPT_POWERS:
        return _first_powers(base)[:n]
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: So many powers of a base are kept: a piece of 1 MB and one more.
KEPT_POWERS = (1 << 20) + 1


@cache
def _first_powers(base: int) -> np.ndarray:
    out = np.full(KEPT_POWERS, base, dtype=np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    out.flags.writeable = False
    return out


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (length: texts + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[raw]
    edge = np.zeros(n + 1, dtype=bool)        # a text begins here
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial over random byte codes, then mixed."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[raw] * _powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_BASE_INV, n + 1)[start] + (end - start).astype(np.uint64) * _P)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words (positions 0 .. len - k), order kept."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _U(_BASE) + words[i:i + n]
    return mix(h)


# -- arrays dealt by bucket -----------------------------------------------------------------------
# Millions of small records travel as a few binary rows: a task sorts its records by bucket and sends
# one row per bucket with the records' columns as bytes. The number of buckets grows with the input, so
# a bucket's content stays bounded.

def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row ``bucket, n, c0, c1, ...`` per bucket that occurs; equal buckets keep their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], cut, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    n = np.diff(bounds)
    out = [pa.array(bucket[bounds[:-1]].astype(np.int32)), pa.array(n.astype(np.int32))]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        off = (bounds * c.dtype.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(c.tobytes())]))
    return pa.RecordBatch.from_arrays(out, names=["bucket", "n", *(f"c{i}" for i in range(len(columns)))])


def packed_schema(columns: int) -> str:
    return ", ".join(["bucket int", "n int", *(f"c{i} binary" for i in range(columns))])


def unpack(batches, dtypes: list):
    """(bucket, arrays) for each bucket of a stream of packed rows that is sorted by bucket."""
    now, parts = None, []

    def done():
        return now, [np.concatenate([np.frombuffer(p[i], d) for p in parts]) for i, d in enumerate(dtypes)]

    for batch in batches:
        buckets = batch.column("bucket").to_pylist()
        columns = [batch.column(f"c{i}") for i in range(len(dtypes))]
        for r, bucket in enumerate(buckets):
            if bucket != now and parts:
                yield done()
                parts = []
            now = bucket
            parts.append([c[r].as_buffer() for c in columns])
    if parts:
        yield done()


def to_buckets(packed: DataFrame, buckets: int) -> DataFrame:
    """All rows of a bucket to one task, buckets in order."""
    return packed.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket")
