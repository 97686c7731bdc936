"""Connected components of an undirected graph by alternating star operations.

Each round links every vertex to the smallest vertex of its neighbourhood,
first for larger neighbours (large star), then for smaller ones (small star).
The number of rounds is logarithmic in practice whatever the graph's diameter.
Minima are pre-aggregated before their shuffle, and rounds are cut from each
other by tables in the shared folder.

The root of a large component ends up with all its vertices as neighbours. Each
round measures the largest number of neighbours; beyond ``hub_rows`` of them,
a vertex's rows are dealt to salts of about that many rows, and its minimum is
sent to the salts that hold rows of it, so no task gets a whole hub.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_path, new_path

MAX_ROUNDS = 100
HUB_ROWS = 1_000_000


def _beside_least(pairs: DataFrame, key: str, value: str, salts: int) -> DataFrame:
    """``pairs`` with ``m``, the smallest ``value`` among the rows of the same ``key``."""
    if salts == 1:
        return pairs.join(pairs.groupBy(key).agg(F.min(value).alias("m")), key)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hub_rows: int = HUB_ROWS) -> DataFrame:
    """``id long, component long``: each vertex of an edge with the smallest vertex it is connected to.

    Loops make a vertex known; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = known.where(a == b).select(a.alias("id")).distinct()
    stars = known.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path, mark = None, None
    for _ in range(MAX_ROUNDS):
        old, path = path, new_path(spark, "stars")
        stars.write.parquet(path)
        now = spark.read.schema(stars.schema).parquet(path)
        if old:
            drop_path(spark, old)
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        around = both.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        found = around.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("hub")).first()
        if (found["n"], found["h"]) == mark or not found["n"]:
            break
        mark = (found["n"], found["h"])
        salts = max(1, ceil(found["hub"] / hub_rows))
        large = _beside_least(both, "a", "b", salts).where("b > a").select(F.col("b").alias("u"), F.least("a", "m").alias("v")).distinct()
        small = _beside_least(large, "u", "v", salts)
        stars = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    joined = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    alone = loops.join(joined, "id", "left_anti").select("id", F.col("id").alias("component"))
    return joined.union(alone)
