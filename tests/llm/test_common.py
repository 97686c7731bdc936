from pyspark.sql import functions as F

from quarryline.llm.common import SPREAD_BYTES, spread_table


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def exchanges(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_one_row_group_is_spread_over_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    docs = docs.union(docs.limit(100))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = spread_table(spark, str(tmp_path), "documents")
    assert tasks(spark.read.parquet(str(tmp_path / "documents.parquet"))) == 1 and tasks(got) == cores
    assert got.columns == docs.columns and got.exceptAll(docs).count() == 0 and got.count() == 20_100
    docs.repartition(4 * cores).write.parquet(str(tmp_path / "pages.parquet"))
    assert tasks(spark.read.parquet(str(tmp_path / "pages.parquet"))) >= cores
    assert exchanges(got) and not exchanges(spread_table(spark, str(tmp_path), "pages"))


def test_small_and_empty_tables_are_read_as_they_are(spark, tmp_path):
    small = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string")
    small.write.parquet(str(tmp_path / "documents.parquet"))
    small.limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert SPREAD_BYTES > 10_000
    for name, n in (("documents", 3), ("pages", 0)):
        got = spread_table(spark, str(tmp_path), name)
        assert not exchanges(got) and got.count() == n
