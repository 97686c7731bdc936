"""Text formats as DataFrames.

Transactions are read leniently (tokens that are no integers are dropped);
graphs and points strictly (a bad token stops the job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import drop_trailing_empty, dropped_tokens, lenient_ints, strict


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """``value``: one row per line."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def read_transactions(spark: SparkSession, path: str | list[str], separator: str = r"\s+", partitions: int | None = None) -> DataFrame:
    """``tid long, items array<int>``: every line is a transaction, even one without items."""
    lines = read_lines(spark, path, partitions)
    return lines.select(F.monotonically_increasing_id().alias("tid"), lenient_ints(F.col("value"), separator).alias("items"))


def parsing_issues(spark: SparkSession, path: str | list[str], separator: str = r"\s+") -> DataFrame:
    """``lines long, issues long``: lines, and tokens that are no integers."""
    return read_lines(spark, path).agg(F.count("*").alias("lines"), F.coalesce(F.sum(dropped_tokens(F.col("value"), separator)), F.lit(0)).cast("long").alias("issues"))


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``src long, dst long``: two ids a line; empty lines and lines that begin with # are passed over."""
    line = F.col("value")
    edge = (line != "") & ~line.startswith("#")
    ids = strict(F.slice(drop_trailing_empty(F.split(line, r"\s+")), 1, 2), "long", line)
    both = F.when(F.size(ids) == 2, ids).otherwise(F.raise_error(F.concat(F.lit("not an edge: '"), line, F.lit("'"))).cast("array<long>"))
    # the condition is told twice: filters may be evaluated in any order, and other lines must not raise
    return read_lines(spark, path).where(edge).select(F.when(edge, both).alias("ids")).select(F.col("ids")[0].alias("src"), F.col("ids")[1].alias("dst"))


def _adjacency(spark: SparkSession, path: str | list[str], kind: str, partitions: int | None) -> DataFrame:
    line = F.col("value")
    return read_lines(spark, path, partitions).select(strict(drop_trailing_empty(F.split(line, r"\s+")), kind, line).alias("ids"))


def read_adjacency_edges(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """``src long, dst long`` of lines ``src dst dst ...``."""
    return _adjacency(spark, path, "long", partitions).select(F.col("ids")[0].alias("src"), F.explode(F.expr("slice(ids, 2, size(ids))")).alias("dst"))


def read_adjacency_rows(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """``src int, dsts array<int>``, line by line."""
    return _adjacency(spark, path, "int", partitions).select(F.col("ids")[0].alias("src"), F.expr("slice(ids, 2, size(ids))").alias("dsts"))


def read_graph(spark: SparkSession, path: str | list[str], kind: str = "edges", partitions: int | None = None) -> DataFrame:
    """Edges from a file of ``edges`` or of ``adjLists``."""
    if kind == "edges":
        return read_edges(spark, path)
    if kind == "adjLists":
        return read_adjacency_edges(spark, path, partitions)
    raise ValueError(f"a graph is read from 'edges' or 'adjLists', not from {kind!r}")


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``x array<double>``: values between single spaces, the first column (a label) dropped. Blank lines, double or leading spaces and lines of another length stop the job."""
    line = F.col("value")
    tokens = F.split(line, " ")
    bad = (F.size(tokens) < 2) | F.exists(tokens, lambda t: t == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a labelled point: '"), line, F.lit("'"))).cast("array<string>")).otherwise(tokens)
    return read_lines(spark, path).select(strict(F.slice(checked, 2, 2_000_000_000), "double", line).alias("x"))


def read_key_bytes(spark: SparkSession, paths: str | list[str], key_separator: str = "") -> DataFrame:
    """``file, key, bytes``: the last token of a line is a number of bytes, the others make the key (joined without a separator, so ``a b`` and ``ab`` are one key). Paths may be a list or separated by ``;``."""
    paths = paths.split(";") if isinstance(paths, str) else paths
    line = F.col("value")
    tokens = drop_trailing_empty(F.split(line, r"\s+"))
    last = strict(F.slice(tokens, -1, 1), "long", line)[0]
    key = F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), key_separator)
    return spark.read.text(paths).select(F.input_file_name().alias("file"), key.alias("key"), last.alias("bytes"))


def read_key_tree(spark: SparkSession, root: str, skip_equal_sizes: bool = False) -> DataFrame:
    """``app, stage, dep, key`` of the files ``root/app/stage/dep/*``, one key a line.

    ``skip_equal_sizes``: of an application's dependencies with the same total size only the first by name is read.
    """
    parts = lambda path: [F.element_at(F.split(path, "/"), -k) for k in (4, 3, 2)]
    named = lambda df, path: df.select(*(c.alias(n) for c, n in zip(parts(path), ("app", "stage", "dep"), strict=True)), *(c for c in df.columns if c != "path"))
    keys = named(spark.read.option("recursiveFileLookup", "true").text(root).select(F.input_file_name().alias("path"), F.col("value").alias("key")), F.col("path"))
    if not skip_equal_sizes:
        return keys
    files = named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"), F.col("path"))
    sizes = files.groupBy("app", "stage", "dep").agg(F.sum("length").alias("bytes"))
    first = sizes.groupBy("app", "bytes").agg(F.min(F.struct("stage", "dep")).alias("d")).select("app", "d.stage", "d.dep")
    return keys.join(first, ["app", "stage", "dep"], "left_semi")


_LONG = ": long"
_METRICS = ", ".join([
    *(f"`{n}`{_LONG}" for n in ("Executor Run Time", "JVM GC Time", "Memory Bytes Spilled", "Disk Bytes Spilled")),
    f"`Input Metrics`: struct<`Records Read`{_LONG}>",
    f"`Shuffle Read Metrics`: struct<`Total Records Read`{_LONG}, `Local Bytes Read`{_LONG}, `Remote Bytes Read`{_LONG}>",
    f"`Shuffle Write Metrics`: struct<`Shuffle Records Written`{_LONG}, `Shuffle Bytes Written`{_LONG}>",
])
_RDD = f"struct<`RDD ID`{_LONG}, `Name`: string, `Parent IDs`: array<long>, `Callsite`: string>"
_STAGE = f"struct<`Stage ID`{_LONG}, `Stage Name`: string, `Number of Tasks`{_LONG}, `Parent IDs`: array<long>, `RDD Info`: array<{_RDD}>>"
_EVENT = f"`Event` string, `Stage ID` long, `Stage Info` {_STAGE}, `Task Info` struct<`Index`{_LONG}>, `Task Metrics` struct<{_METRICS}>"


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An application's event log as ``stages``, ``stage_rdds`` and ``tasks``; lines that are no JSON are passed over.

    Missing numbers are 0, those of spilled bytes null.
    """
    log = spark.read.schema(_EVENT).json(path)
    info = log.where(F.col("Event") == "SparkListenerStageSubmitted").select(F.col("Stage Info").alias("s"))
    stages = info.select(F.col("s.Stage ID").alias("stage_id"), F.col("s.Stage Name").alias("stage_name"), F.col("s.Number of Tasks").alias("num_tasks"), F.col("s.Parent IDs").alias("parent_ids")).dropDuplicates(["stage_id"])
    rdds = info.select(F.col("s.Stage ID").alias("stage_id"), F.explode("s.RDD Info").alias("r")).select("stage_id", F.col("r.RDD ID").alias("rdd_id"), F.col("r.Name").alias("name"), F.col("r.Parent IDs").alias("parent_ids"), F.col("r.Callsite").alias("callsite")).distinct()

    def metric(name: str, default: int | None = 0) -> Column:
        c = F.col(f"Task Metrics.{name}")
        return c if default is None else or_else(c, default)

    tasks = log.where(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("Stage ID").alias("stage_id"), F.col("Task Info.Index").alias("task"), metric("Executor Run Time").alias("run_time"), metric("JVM GC Time").alias("gc_time"),
        metric("Memory Bytes Spilled", None).alias("memory_spilled"), metric("Disk Bytes Spilled", None).alias("disk_spilled"), metric("Input Metrics.Records Read").alias("input_records"),
        metric("Shuffle Read Metrics.Total Records Read").alias("shuffle_read_records"), (metric("Shuffle Read Metrics.Local Bytes Read") + metric("Shuffle Read Metrics.Remote Bytes Read")).alias("shuffle_read_bytes"),
        metric("Shuffle Write Metrics.Shuffle Records Written").alias("shuffle_write_records"), metric("Shuffle Write Metrics.Shuffle Bytes Written").alias("shuffle_write_bytes"),
    )
    return stages, rdds, tasks


def or_else(c: Column, default: object) -> Column:
    """The value, or a default if there is none."""
    return F.coalesce(c, F.lit(default))
