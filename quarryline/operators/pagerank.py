"""PageRank in two definitions.

``adjacency_pagerank``: ranks start at 1 for every source; a round gives
``0.15 + 0.85 * sum`` to every vertex that receives something.  Vertices
without a link to them are gone after the first round and pass nothing on.

``graph_pagerank``: every vertex keeps a rank; one that receives nothing has
``reset_prob``.  Ranks are not normalised in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Rounds after which the lineage is cut.
CUT_EVERY = 5


def _with_degree(edges: DataFrame) -> DataFrame:
    known = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return known.join(known.groupBy("src").agg(F.count("*").alias("deg")), "src")


def adjacency_pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, keep_sources: bool = False) -> DataFrame:
    """``id long, rank double``. A source's lines are merged; ``keep_sources`` gives vertices that only link ``1 - damping`` instead of dropping them."""
    links = materialize(_with_degree(edges), "links")
    sources = links.select(F.col("src").alias("id")).distinct()
    ranks = sources.withColumn("rank", F.lit(1.0))
    for i in range(1, rounds + 1):
        sent = links.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("rank") / F.col("deg")).alias("part"))
        ranks = sent.groupBy("id").agg((F.lit(1 - damping) + damping * F.sum("part")).alias("rank"))
        if keep_sources:
            ranks = ranks.join(sources, "id", "full").select("id", F.coalesce("rank", F.lit(1 - damping)).alias("rank"))
        if i % CUT_EVERY == 0 and i < rounds:
            ranks = materialize(ranks, "ranks")
    return ranks


def adjacency_pagerank_by_line(rows: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """The same for adjacency rows ``src, dsts`` that are not merged: a source on m lines starts with m ranks, and each line shares out every one of them."""
    lines = materialize(rows.select(F.col("src").cast("long").alias("src"), "dsts"), "lines")
    ranks = lines.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    for i in range(1, rounds + 1):
        sent = lines.join(ranks.withColumnRenamed("id", "src"), "src").select(F.explode("dsts").alias("id"), (F.col("rank") / F.size("dsts")).alias("part"))
        ranks = sent.groupBy(F.col("id").cast("long").alias("id")).agg((F.lit(1 - damping) + damping * F.sum("part")).alias("rank"))
        if i % CUT_EVERY == 0 and i < rounds:
            ranks = materialize(ranks, "ranks")
    return ranks


def graph_pagerank(edges: DataFrame, rounds: int, reset_prob: float = 0.15, initial: float = 1.0) -> DataFrame:
    """``id long, rank double`` of all vertices."""
    links = materialize(_with_degree(edges), "links")
    vertices = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    ranks = vertices.withColumn("rank", F.lit(float(initial)))
    for i in range(1, rounds + 1):
        sent = links.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("rank") / F.col("deg")).alias("part"))
        got = sent.groupBy("id").agg(F.sum("part").alias("got"))
        ranks = vertices.join(got, "id", "left").select("id", (F.lit(reset_prob) + (1 - reset_prob) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % CUT_EVERY == 0 and i < rounds:
            ranks = materialize(ranks, "ranks")
    return ranks


def vertices(edges: DataFrame) -> DataFrame:
    """``id``: distinct ends of edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
