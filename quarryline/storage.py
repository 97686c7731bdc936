"""Where intermediate tables live.

Lineage is cut by writing Parquet tables below ``spark.checkpoint.dir``, the
folder that the driver and every executor share; only a local session that has none (as in
tests) uses a folder of this machine.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared checkpoint folder, removed when the JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        _own[app] = f"{base.rstrip('/')}/quarryline-{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(_own[app])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that nothing refers to any more; it notices only when the JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, name: str = "table", buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, but rows lie in buckets of ``key`` (as many as there are shuffle partitions, or ``buckets``): joins and groups by it read them without a shuffle."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"quarryline_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(table)
    found = spark.table(table).select("*")
    spark.sql(f"DROP TABLE {table}")  # the plan keeps the files and their buckets; the catalog needs no entry
    return found


def storage_info(df: DataFrame) -> str:
    """How a DataFrame is kept: ``memory``, ``disk``, both, or ``not stored``, and how many copies of it."""
    level = df.storageLevel
    kept = [name for name, on in (("memory", level.useMemory), ("disk", level.useDisk)) if on]
    return f"{' and '.join(kept)}, {level.replication}x" if kept else "not stored"
