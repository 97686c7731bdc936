"""Queries of the event-log analyzer over a log that is written from the events table, and the SQL of the same rows.

Each event is a finished task.  Event types are numbered; the first three are
points with four RDDs each (iterative), made for the policies of empty tasks,
spill and garbage collection; the others are points of one RDD each, made for
the kinds of imbalance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions.skew import defined_correlation
from ..operators import tuning
from ..sources.readers import read_event_log
from ..sources.writers import write_lines
from ..storage import new_path
from .catalog import _table

#: Measures of the tasks, as SQL that both engines read: r numbers event types, p the RDDs of a point, k is the number in an event's properties.
_FACTS = {
    "run_time": "CASE WHEN r = 4 THEN 1 + k * k * k ELSE 5 END",
    "gc_time": "CASE WHEN r = 3 THEN 1 + k * k ELSE 0 END",
    "input_records": "CASE WHEN r = 1 THEN user_id % 3 WHEN r = 4 THEN 0 ELSE 1 + user_id % 5 END",
    "shuffle_read_records": "CASE WHEN r = 4 AND p = 0 THEN 1 + k * k * k WHEN r = 4 THEN 1 ELSE 0 END",
    "shuffle_read_bytes": "CASE WHEN r = 4 AND p <= 1 THEN 10 + 10 * k * k * k WHEN r = 4 THEN 7 ELSE 0 END",
    "shuffle_write_bytes": "CASE WHEN r = 2 THEN 300 ELSE 0 END",
    "shuffle_write_records": "CASE WHEN r = 2 THEN 3 ELSE 0 END",
    "memory_spilled": "CASE WHEN r = 2 THEN 1000 ELSE 0 END",
}
_POINT = "CASE WHEN r <= 3 THEN 'adaptive-' || event_type ELSE event_type || '-' || p END"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kinds = events.select("event_type").distinct().withColumn("r", F.expr("CAST(dense_rank() OVER (ORDER BY event_type) AS LONG)"))
    rows = events.join(F.broadcast(kinds), "event_type").withColumn("p", F.expr("event_id % 4")).withColumn("stage_id", F.expr("4 * r + p")).withColumn("point", F.expr(_POINT))  # a few kinds of events
    return rows.select("event_id", "event_type", "r", "p", "stage_id", "point", *(F.expr(f"CAST({sql} AS LONG)").alias(name) for name, sql in _FACTS.items()))


def event_log(spark: SparkSession, d: str) -> str:
    """Path of a log in the application's JSON format."""
    rows = _tasks(spark, d)
    metrics = F.struct(
        F.col("run_time").alias("Executor Run Time"), F.col("gc_time").alias("JVM GC Time"), F.col("memory_spilled").alias("Memory Bytes Spilled"), F.lit(0).alias("Disk Bytes Spilled"), F.struct(F.col("input_records").alias("Records Read")).alias("Input Metrics"),
        F.struct(F.col("shuffle_read_records").alias("Total Records Read"), F.col("shuffle_read_bytes").alias("Local Bytes Read"), F.lit(0).alias("Remote Bytes Read")).alias("Shuffle Read Metrics"),
        F.struct(F.col("shuffle_write_records").alias("Shuffle Records Written"), F.col("shuffle_write_bytes").alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
    )
    ends = rows.select(F.to_json(F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), F.col("stage_id").alias("Stage ID"), F.struct(F.col("event_id").alias("Index")).alias("Task Info"), metrics.alias("Task Metrics"))).alias("value"))
    rdd = lambda shift, name: F.struct((F.col("stage_id") * 10 + shift).alias("RDD ID"), name.alias("Name"), F.array().cast("array<long>").alias("Parent IDs"))
    info = F.struct(F.col("stage_id").alias("Stage ID"), F.concat(F.lit("stage of "), "point").alias("Stage Name"), F.col("n").alias("Number of Tasks"), F.array().cast("array<long>").alias("Parent IDs"), F.array(rdd(1, F.lit("later")), rdd(0, F.col("point"))).alias("RDD Info"))
    begins = rows.groupBy("stage_id", "point").agg(F.count("*").alias("n")).select(F.to_json(F.struct(F.lit("SparkListenerStageSubmitted").alias("Event"), info.alias("Stage Info"))).alias("value"))
    path = new_path(spark, "event-log")
    write_lines(begins.union(ends).union(spark.createDataFrame([("no json",)], "value string")), path)
    return path


def event_log_stages(spark: SparkSession, d: str) -> DataFrame:
    stages, rdds, _ = read_event_log(spark, event_log(spark, d))
    return stages.join(tuning.first_rdds(rdds), "stage_id").select("stage_id", "stage_name", "num_tasks", "rdd_id", "point", "n_rdds")


def event_log_tasks(spark: SparkSession, d: str) -> DataFrame:
    return read_event_log(spark, event_log(spark, d))[2].select("stage_id", "task", *_FACTS, "disk_spilled")


def _stats(spark: SparkSession, d: str, only_adaptive: bool = False, thresholds: tuning.Thresholds = tuning.Thresholds()) -> DataFrame:  # noqa: B008
    return tuning.stage_stats(*read_event_log(spark, event_log(spark, d)), only_adaptive, thresholds)


def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    measures = ("gc_skew", "run_skew", "corr_bytes", "corr_records")
    return _stats(spark, d).select("stage_id", "records_read", "shuffle_read_bytes", "shuffle_write_bytes", "shuffle_write_records", "empty_tasks", "bytes_spilled", "gc_min", "gc_max", *(F.round(m, 6).alias(m) for m in measures))


def adaptive_points(spark: SparkSession, d: str) -> DataFrame:
    """Points with an adaptive name only."""
    return tuning.points(_stats(spark, d, True)).select("point", F.size("instances").alias("n"), "iterative", "regular", F.col("instances")[0]["main"]["stage_id"].alias("first_stage"))


def imbalance_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("stage_id", tuning.imbalance_kind(tuning.Thresholds()).alias("kind"))


def _policy(policy: tuning.Policy) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        answer = policy(tuning.Thresholds())
        return _stats(spark, d).select("stage_id", answer["action"].alias("action"), answer["arg"].alias("arg"))

    return query


def tuning_plan(spark: SparkSession, d: str) -> DataFrame:
    return tuning.analyze(spark, event_log(spark, d))


def tuning_plan_text(spark: SparkSession, d: str) -> DataFrame:
    """The command's report."""
    return spark.createDataFrame([(cli.run(spark, ["analyze", event_log(spark, d)]),)], "text string")


def tuning_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is high enough: neither garbage nor imbalance is seen."""
    return tuning.plan(_stats(spark, d), thresholds=tuning.Thresholds(skewness=1e9)).select(*tuning.PLAN)


def tuning_measures(spark: SparkSession, d: str) -> DataFrame:
    """Other measures: correlation counts as 1 wherever it is defined, and every stage as skewed."""
    t = tuning.Thresholds(measure_skew=lambda c: F.lit(3.0), measure_correlation=defined_correlation)
    return _stats(spark, d, thresholds=t).select("stage_id", "run_skew", "corr_bytes", tuning.imbalance_kind(t).alias("kind"))


def tuning_own_policy(spark: SparkSession, d: str) -> DataFrame:
    """A caller's policy, asked for stages that no default policy answers (the last default one always answers, so a policy of warnings takes its place here)."""
    stats, t = _stats(spark, d), tuning.Thresholds()
    own = F.when(F.col("run_skew") > 1, tuning.action(tuning.WARN, "uneven"))
    answer = F.coalesce(*(p(t) for p in tuning.DEFAULT_POLICIES[:-1]), own, tuning.action(tuning.NO_ACTION))
    return stats.select("stage_id", answer["action"].alias("action"), answer["arg"].alias("arg"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_log_stages": event_log_stages,
    "event_log_tasks": event_log_tasks,
    "stage_totals": stage_totals,
    "adaptive_points": adaptive_points,
    "imbalance_kinds": imbalance_kinds,
    "policy_empty_tasks": _policy(tuning.drop_empty_tasks),
    "policy_spill": _policy(tuning.avoid_spill),
    "policy_garbage": _policy(tuning.spread_garbage),
    "policy_imbalance": _policy(tuning.mend_imbalance),
    "tuning_plan": tuning_plan,
    "tuning_plan_text": tuning_plan_text,
    "tuning_thresholds": tuning_thresholds,
    "tuning_measures": tuning_measures,
    "tuning_own_policy": tuning_own_policy,
}

_MEASURED = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in _FACTS.items())
_T = f"""WITH q AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS r, event_id % 4 AS p FROM events),
t AS (SELECT 4 * r + p AS stage_id, {_POINT} AS point, event_id AS task, {_MEASURED} FROM q),
u AS (SELECT *, input_records + shuffle_read_records AS records FROM t),
s AS (SELECT stage_id, point, stage_id * 10 AS rdd_id, count(*) AS num_tasks, CAST(sum(records) AS BIGINT) AS records_read, CAST(sum(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes, CAST(sum(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes,
CAST(sum(shuffle_write_records) AS BIGINT) AS shuffle_write_records, CAST(sum(CASE WHEN records = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_tasks, CAST(sum(memory_spilled) AS BIGINT) AS bytes_spilled, min(gc_time) AS gc_min, max(gc_time) AS gc_max,
CASE WHEN avg(gc_time) = 0 THEN 1 ELSE max(gc_time) / avg(gc_time) END AS gc_skew, CASE WHEN avg(run_time) = 0 THEN 1 ELSE max(run_time) / avg(run_time) END AS run_skew,
CASE WHEN stddev_pop(run_time) * stddev_pop(shuffle_read_bytes) > 0 THEN covar_pop(run_time, shuffle_read_bytes) / (stddev_pop(run_time) * stddev_pop(shuffle_read_bytes)) ELSE 0 END AS corr_bytes,
CASE WHEN stddev_pop(run_time) * stddev_pop(shuffle_read_records) > 0 THEN covar_pop(run_time, shuffle_read_records) / (stddev_pop(run_time) * stddev_pop(shuffle_read_records)) ELSE 0 END AS corr_records FROM u GROUP BY stage_id, point),
w AS (SELECT *, CASE WHEN run_skew <= 2 THEN 'balanced' WHEN abs(corr_bytes) >= 0.7 AND abs(corr_records) >= 0.7 THEN 'key distribution' WHEN abs(corr_bytes) >= 0.7 OR abs(corr_records) >= 0.7 THEN 'variable cost' ELSE 'inherent' END AS kind FROM s),
x AS (SELECT *, CASE WHEN empty_tasks > 0 THEN greatest(1, num_tasks - empty_tasks) END AS a, CASE WHEN shuffle_write_bytes > 0 AND bytes_spilled // shuffle_write_bytes > 0 THEN bytes_spilled // shuffle_write_bytes * num_tasks END AS b, CASE WHEN gc_skew > 2 AND gc_min > 0 THEN gc_max // gc_min * num_tasks END AS c FROM w),
y AS (SELECT *, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN 'act-unp' WHEN kind = 'key distribution' THEN 'act-up' WHEN kind = 'balanced' THEN 'no-act' ELSE 'act-wrn' END AS action,
CASE WHEN coalesce(a, b, c) IS NOT NULL THEN CAST(coalesce(a, b, c) AS VARCHAR) WHEN kind = 'key distribution' THEN 'rangePartitioner' WHEN kind = 'inherent' THEN '{tuning.INHERENT}' WHEN kind = 'variable cost' THEN '{tuning.SPECIALISE}' END AS arg FROM x),
g AS (SELECT point, list_reduce(list(records_read ORDER BY rdd_id), lambda a, x: CASE WHEN a = -1 OR a = x THEN x ELSE -1 END) <> -1 AS regular FROM y GROUP BY point),
z AS (SELECT y.*, row_number() OVER o - 1 AS seq, first_value(action) OVER o AS action0, first_value(arg) OVER o AS arg0, first_value(records_read) OVER o AS read0, first_value(stage_id) OVER o AS begun, g.regular FROM y JOIN g USING (point) WINDOW o AS (PARTITION BY point ORDER BY rdd_id)),
plan AS (SELECT point AS adaptive_point, CAST(seq AS INTEGER) AS seq, action0 AS action, CASE WHEN seq > 0 AND action0 = 'act-unp' AND NOT regular AND read0 > 0 THEN CAST(greatest(1, CAST(ceil(records_read / CAST(read0 AS DOUBLE) * CAST(arg0 AS DOUBLE)) AS BIGINT)) AS VARCHAR) ELSE arg0 END AS arg, begun FROM z)"""


def _policy_sql(letter: str) -> str:
    return f"{_T} SELECT stage_id, CASE WHEN {letter} IS NOT NULL THEN 'act-unp' END AS action, CAST({letter} AS VARCHAR) AS arg FROM x"


ORACLES: dict[str, str] = {
    "event_log_stages": f"{_T} SELECT stage_id, 'stage of ' || point AS stage_name, num_tasks, rdd_id, point, CAST(2 AS BIGINT) AS n_rdds FROM s",
    "event_log_tasks": f"{_T} SELECT stage_id, task, {', '.join(_FACTS)}, CAST(0 AS BIGINT) AS disk_spilled FROM t",
    "stage_totals": f"{_T} SELECT stage_id, records_read, shuffle_read_bytes, shuffle_write_bytes, shuffle_write_records, empty_tasks, bytes_spilled, gc_min, gc_max, round(gc_skew, 6) AS gc_skew, round(run_skew, 6) AS run_skew, round(corr_bytes, 6) AS corr_bytes, round(corr_records, 6) AS corr_records FROM s",
    "adaptive_points": f"{_T} SELECT point, CAST(count(*) AS INTEGER) AS n, count(*) > 1 AS iterative, bool_and(regular) AS regular, min(begun) AS first_stage FROM z WHERE contains(point, 'adaptive') GROUP BY point",
    "imbalance_kinds": f"{_T} SELECT stage_id, kind FROM w",
    "policy_empty_tasks": _policy_sql("a"),
    "policy_spill": _policy_sql("b"),
    "policy_garbage": _policy_sql("c"),
    "policy_imbalance": f"{_T} SELECT stage_id, CASE kind WHEN 'key distribution' THEN 'act-up' WHEN 'balanced' THEN 'no-act' ELSE 'act-wrn' END AS action, CASE kind WHEN 'key distribution' THEN 'rangePartitioner' WHEN 'inherent' THEN '{tuning.INHERENT}' WHEN 'variable cost' THEN '{tuning.SPECIALISE}' END AS arg FROM w",
    "tuning_plan": f"{_T} SELECT adaptive_point, seq, action, arg FROM plan",
    "tuning_plan_text": f"{_T} SELECT string_agg(concat_ws(',', action, adaptive_point, arg), ';' ORDER BY begun, seq) AS text FROM plan",
    "tuning_thresholds": f"{_T.replace('gc_skew > 2 ', 'gc_skew > 1e9 ').replace('run_skew <= 2', 'run_skew <= 1e9')} SELECT adaptive_point, seq, action, arg FROM plan",
    "tuning_measures": f"{_T}, v AS (SELECT stage_id, CASE WHEN stddev_pop(run_time) * stddev_pop(shuffle_read_bytes) > 0 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN stddev_pop(run_time) * stddev_pop(shuffle_read_records) > 0 THEN 1.0 ELSE 0.0 END AS n FROM t GROUP BY stage_id) SELECT stage_id, CAST(3 AS DOUBLE) AS run_skew, CAST(b AS DOUBLE) AS corr_bytes, CASE WHEN b + n = 2 THEN 'key distribution' WHEN b + n = 1 THEN 'variable cost' ELSE 'inherent' END AS kind FROM v",
    "tuning_own_policy": f"{_T} SELECT stage_id, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN 'act-unp' WHEN run_skew > 1 THEN 'act-wrn' ELSE 'no-act' END AS action, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN CAST(coalesce(a, b, c) AS VARCHAR) WHEN run_skew > 1 THEN 'uneven' END AS arg FROM x",
}
