"""Frequencies and bytes of keys, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(rows: DataFrame, key: Column | str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """``key, n`` (within each of the ``by`` columns); all inputs are counted in one job."""
    return rows.groupBy(*by, (F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("n"))


def sorted_key_counts(rows: DataFrame, key: Column | str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """In the string order of the keys."""
    counts = key_counts(rows, key, by)
    return counts.orderBy(*by, F.col("key").cast("string"))


def bytes_per_key(rows: DataFrame, key: str = "key", size: str = "bytes", by: tuple[str, ...] = ()) -> DataFrame:
    """``key, n, bytes``."""
    return rows.groupBy(*by, F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


def bernoulli_sample(rows: DataFrame, fraction: float = 0.1, seed: int = 1) -> DataFrame:
    """Each row with the same probability, without replacement; repeatable for the same partitioning."""
    return rows.sample(False, fraction, seed)


def hash_sample(rows: DataFrame, key: Column, percent: int) -> DataFrame:
    """Rows whose key hashes below a bound; the same rows for every partitioning and engine."""
    return rows.where(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 100 < percent)
