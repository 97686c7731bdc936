"""From raw documents to packed sequences: each stage works on what the one before has written.

The stages but the last return the columns of documents.  Rows whose score is
toxic go, then all but one document of each near-duplicate group, then bytes
that repeat from documents with smaller ids, then documents in which benchmark
items occur; what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontamination, packing, repeats, simhash, toxicity
from quarryline.llm.common import fold, spread_table, table
from quarryline.storage import new_path

ORACLE_SQL = None
"""The stages have no SQL form; tests compare them with brute force."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is learned as in the operator's own query."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT)
    return toxicity.filter_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have; ``n_chars`` counts what is left."""
    return repeats.remove_repeats(docs, n_chars="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, packing.read_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spread_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
