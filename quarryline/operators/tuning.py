"""From an application's event log to a repartitioning report.

Everything is a DataFrame: task metrics are aggregated by stage, stages are
grouped by their first RDD, and a policy is a column over a stage's totals that
gives an action or null; the first policy with an answer counts (empty tasks,
spill, garbage collection, imbalance of run times, then the caller's own).  A
point that several RDDs share is iterative: if its stages always read the same
amounts, the first answer is copied, else it is scaled by the records read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import skew
from ..sources.readers import read_event_log

HIGH_SKEWNESS, HIGH_CORRELATION = 2.0, 0.7
PLAN = ["adaptive_point", "seq", "action", "arg"]
NO_ACTION, UPDATE_PARTITIONS, UPDATE_PARTITIONER, WARN = "no-act", "act-unp", "act-up", "act-wrn"
PARTITIONERS = ("hashPartitioner", "rangePartitioner")
INHERENT = "the imbalance is inherent, look at the function that makes this data"
SPECIALISE = "consider a partitioner that knows the layout of the data"


@dataclass(frozen=True)
class Thresholds:
    """What counts as high, and how skewness (of one column) and correlation (of two) are measured; both are aggregates."""

    skewness: float = HIGH_SKEWNESS
    correlation: float = HIGH_CORRELATION
    measure_skew: Callable[[Column], Column] = skew.skewness
    measure_correlation: Callable[[Column, Column], Column] = skew.correlation

    def high_skew(self, c: str) -> Column:
        return F.coalesce(F.col(c) > self.skewness, F.lit(False))

    def high_corr(self, c: str) -> Column:
        return F.coalesce(F.abs(F.col(c)) >= self.correlation, F.lit(False))


Policy = Callable[[Thresholds], Column]
"""A column over the rows of ``stage_stats``: ``action(...)``, or null for no answer."""


def action(kind: str, arg: Column | str | None = None) -> Column:
    arg = F.lit(arg) if arg is None or isinstance(arg, str) else arg
    return F.struct(F.lit(kind).alias("action"), arg.cast("string").alias("arg"))


def drop_empty_tasks(t: Thresholds) -> Column:
    """As many partitions as there are tasks with something to read."""
    return F.when(F.col("empty_tasks") > 0, action(UPDATE_PARTITIONS, F.greatest(F.lit(1), F.col("num_tasks") - F.col("empty_tasks"))))


def avoid_spill(t: Thresholds) -> Column:
    times = F.expr("CASE WHEN shuffle_write_bytes > 0 THEN bytes_spilled DIV shuffle_write_bytes ELSE 0 END")
    return F.when(times > 0, action(UPDATE_PARTITIONS, times * F.col("num_tasks")))


def spread_garbage(t: Thresholds) -> Column:
    return F.when(t.high_skew("gc_skew") & (F.col("gc_min") > 0), action(UPDATE_PARTITIONS, F.expr("CASE WHEN gc_min > 0 THEN gc_max DIV gc_min END") * F.col("num_tasks")))


def imbalance_kind(t: Thresholds) -> Column:
    """Whether tasks run equally long, and if not, how many of the two amounts they read explain it."""
    explained = t.high_corr("corr_bytes").cast("int") + t.high_corr("corr_records").cast("int")
    return F.when(~t.high_skew("run_skew"), "balanced").otherwise(F.element_at(F.array(F.lit("inherent"), F.lit("variable cost"), F.lit("key distribution")), explained + 1))


def mend_imbalance(t: Thresholds) -> Column:
    answers = {"key distribution": action(UPDATE_PARTITIONER, PARTITIONERS[1]), "inherent": action(WARN, INHERENT), "variable cost": action(WARN, SPECIALISE), "balanced": action(NO_ACTION)}
    return F.coalesce(*(F.when(imbalance_kind(t) == kind, answer) for kind, answer in answers.items()))


DEFAULT_POLICIES: tuple[Policy, ...] = (drop_empty_tasks, avoid_spill, spread_garbage, mend_imbalance)


def stage_totals(tasks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Per stage: records read, written and shuffled, bytes spilled, empty tasks, and measures of skew."""
    read = F.col("input_records") + F.col("shuffle_read_records")
    return tasks.groupBy("stage_id").agg(
        F.sum(read).alias("records_read"), F.sum("input_records").alias("input_records"), F.sum("shuffle_read_records").alias("shuffle_read_records"), F.sum("shuffle_read_bytes").alias("shuffle_read_bytes"),
        F.sum("shuffle_write_records").alias("shuffle_write_records"), F.sum("shuffle_write_bytes").alias("shuffle_write_bytes"), F.sum(F.when(read == 0, 1).otherwise(0)).alias("empty_tasks"),
        F.coalesce(F.sum(F.coalesce("memory_spilled", F.lit(0)) + F.coalesce("disk_spilled", F.lit(0))), F.lit(0)).alias("bytes_spilled"),
        t.measure_skew(F.col("gc_time")).alias("gc_skew"), F.min("gc_time").alias("gc_min"), F.max("gc_time").alias("gc_max"), t.measure_skew(F.col("run_time")).alias("run_skew"),
        t.measure_correlation(F.col("run_time"), F.col("shuffle_read_bytes")).alias("corr_bytes"), t.measure_correlation(F.col("run_time"), F.col("shuffle_read_records")).alias("corr_records"),
    )


def first_rdds(rdds: DataFrame) -> DataFrame:
    """Per stage: id and name of its first RDD (the adaptive point), and how many it has."""
    return rdds.groupBy("stage_id").agg(F.min("rdd_id").alias("rdd_id"), F.min_by("name", "rdd_id").alias("point"), F.countDistinct("rdd_id").alias("n_rdds"))


def stage_stats(stages: DataFrame, rdds: DataFrame, tasks: DataFrame, only_adaptive: bool = False, thresholds: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """One row per stage of the log with its point and totals; stages without finished tasks have totals of 0."""
    rows = stages.select("stage_id", "stage_name", "num_tasks").join(first_rdds(rdds), "stage_id").join(stage_totals(tasks, thresholds), "stage_id", "left")
    return (rows.where(F.col("point").contains("adaptive")) if only_adaptive else rows).na.fill(0)


def _includes(larger: Column, smaller: Column) -> Column:
    return F.size(F.array_except(smaller, larger)) == 0


def regular(reads: Column) -> Column:
    """``reads``: for each instance in order an array of (stage name, records read). Whether each instance's contain or are contained in the largest so far; a break starts anew."""
    none = F.filter(reads[0], lambda x: F.lit(False))
    known = F.aggregate(reads, none, lambda k, x: F.when(_includes(x, k), x).when(_includes(k, x), k).otherwise(none))
    return F.size(known) > 0


def points(stats: DataFrame) -> DataFrame:
    """Per adaptive point: its instances (one for each RDD, in order) with the stage that has most RDDs, whether it is iterative, and whether its instances read the same amounts."""
    main = F.max_by(F.struct(*(F.col(c) for c in stats.columns)), F.struct("n_rdds", -F.col("stage_id"))).alias("main")
    reads = F.array_sort(F.collect_set(F.struct("stage_name", "records_read"))).alias("reads")  # the stages of one RDD of one application
    instances = stats.groupBy("point", "rdd_id").agg(main, reads, F.min("stage_id").alias("begun"))
    ordered = F.array_sort(F.collect_list(F.struct("rdd_id", "begun", "main", "reads")))
    grouped = instances.groupBy("point").agg(ordered.alias("instances"))
    return grouped.select("point", "instances", (F.size("instances") > 1).alias("iterative"), regular(F.transform("instances", lambda i: i["reads"])).alias("regular"))


def plan(stats: DataFrame, policies: tuple[Policy, ...] = (), thresholds: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """``PLAN`` and the stage that each row is about: actions of each point, one for each of its RDDs in order. ``policies`` come after the default ones."""
    chain = (*DEFAULT_POLICIES, *policies)
    decided = stats.withColumn("decision", F.coalesce(*(p(thresholds) for p in chain), action(NO_ACTION)))
    each = points(decided).select("point", "regular", F.col("instances")[0]["main"].alias("first"), F.posexplode("instances").alias("seq", "one"))
    factor = F.col("one.main.records_read") / F.col("first.records_read")
    scaled = F.greatest(F.lit(1), F.ceil(factor * F.col("first.decision.arg").try_cast("double")).cast("long")).cast("string")
    moves = (F.col("seq") > 0) & ~F.col("regular") & (F.col("first.records_read") > 0) & (F.col("first.decision.action") == UPDATE_PARTITIONS)
    arg = F.when(moves, scaled).otherwise(F.col("first.decision.arg"))
    return each.select(F.col("point").alias("adaptive_point"), "seq", F.col("first.decision.action").alias("action"), arg.alias("arg"), F.col("one.begun").alias("stage_id"))


def plan_lines(actions: DataFrame) -> DataFrame:
    """``text``: the whole report as one row, points in the order of their first stages."""
    entry = F.concat_ws(",", "action", "adaptive_point", "arg")
    begun = actions.where("seq = 0").select("adaptive_point", F.col("stage_id").alias("begun"))
    rows = actions.join(begun, "adaptive_point").select(F.struct("begun", "seq", entry.alias("entry")).alias("e"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ";").alias("text"))


def plan_text(actions: DataFrame) -> str:
    return plan_lines(actions).first()["text"]


def analyze(spark: SparkSession, path: str, policies: tuple[Policy, ...] = (), thresholds: Thresholds = Thresholds(), only_adaptive: bool = False) -> DataFrame:  # noqa: B008
    """``PLAN`` of an event log."""
    return plan(stage_stats(*read_event_log(spark, path), only_adaptive, thresholds), policies, thresholds).select(*PLAN)
