"""Results as text files; Parquet is what DataFrames write anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _line(sets: DataFrame):
    return F.concat_ws(" ", F.array_join(F.array_sort("items"), ","), F.col("support").cast("string")).alias("value")


def write_itemsets(sets: DataFrame, path: str) -> None:
    """Lines ``i1,i2 support``."""
    sets.select(_line(sets)).write.text(path)


def write_itemset_levels(sets: DataFrame, path: str) -> None:
    """The same, in one directory ``level=k`` for each number of items."""
    sets.select(F.size("items").alias("level"), _line(sets)).write.partitionBy("level").text(path)


def write_itemset_sets(sets: DataFrame, path: str) -> None:
    """Lines ``{i1,i2}: support``."""
    sets.select(F.concat(F.lit("{"), F.array_join("items", ","), F.lit("}: "), F.col("support").cast("string")).alias("value")).write.text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def sample_path(path: str, fraction: float, seed: int) -> str:
    return f"{path}-{fraction}-{seed}.sample"


def write_key_counts(counts: DataFrame, path: str) -> None:
    """Lines ``key n`` in the order of the keys."""
    counts.orderBy("key").select(F.concat_ws(" ", "key", F.col("n").cast("string")).alias("value")).write.text(path)


def aggregated_path(path: str) -> str:
    return path.replace("keydist", "keydist-aggregated")


def write_key_bytes(stats: DataFrame, path: str) -> None:
    """Lines ``key<TAB>n<TAB>bytes``; a ``*`` in the path is dropped."""
    stats.select(F.concat_ws("\t", "key", F.col("n").cast("string"), F.col("bytes").cast("string")).alias("value")).write.text(path.replace("*", "") + ".agg")
