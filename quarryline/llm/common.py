"""What the operators of this package share: byte views of text columns and fixed folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; bounds the memory of a Python worker.
CHUNK_BYTES = 4 << 20
#: Smaller tables are not worth a shuffle, however few tasks scan them.
SPREAD_BYTES = 1 << 20


def give_back() -> None:
    """Returns this process's freed memory to the system; Python workers live on from task to task and keep the most that any needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows lie in at least as many tasks as there are cores.

    A file of few row groups is scanned by few tasks, however large they are.
    The rows of such a table are dealt out once; a table of enough bytes to
    fill all cores' scans, or whose rows already lie in enough tasks, is read as
    it is.  Rows are counted by footers, no column is read for it.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    full_scan = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if not SPREAD_BYTES <= size < cores * full_scan:
        return df
    tasks = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df if tasks >= cores else df.repartition(cores)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for working columns that no column of the input has (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(column: Column | str, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string")) % n


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, one after another, and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut so that each has at most ``limit`` text bytes (or a single row), with their byte views."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = byte_view(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all items of the spans, span after span."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """data[starts[i]:ends[i]] as an Arrow array."""
    lengths = (ends - starts).astype(np.int64)
    picked = data[spans_to_index(starts.astype(np.int64), lengths)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(picked))])


#: The same for each byte of UTF-8 text: lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case letters, and all of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased texts: lower-cased bytes, word starts, word ends, and each text's first word (n + 1 numbers)."""
    low = LOWER[data]
    inside = WORD_BYTE[low]
    if len(low):
        before = np.concatenate([[False], inside[:-1]])
        before[at[:-1][at[:-1] < len(low)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]])
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut <= len(low))]
        after[cut - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return low, starts, ends, np.searchsorted(starts, at)
