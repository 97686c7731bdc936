import json

import pytest

from pyspark.sql import functions as F

from quarryline.functions.skew import correlation, defined_correlation
from quarryline.operators import tuning
from quarryline.sources import readers


def stage(stage_id, rdd_id, name, tasks, n_rdds=1):
    rdds = [{"RDD ID": rdd_id + i, "Name": name if not i else "other", "Parent IDs": []} for i in range(n_rdds)]
    return {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": stage_id, "Stage Name": f"stage {name}", "Number of Tasks": tasks, "Parent IDs": [], "RDD Info": rdds}}


def task(stage_id, index, run=1, gc=0, read=1, bytes_=1, spilled=0, written=0):
    metrics = {"Executor Run Time": run, "JVM GC Time": gc, "Memory Bytes Spilled": spilled, "Disk Bytes Spilled": 0, "Shuffle Read Metrics": {"Total Records Read": read, "Local Bytes Read": bytes_, "Remote Bytes Read": 0}, "Shuffle Write Metrics": {"Shuffle Records Written": 0, "Shuffle Bytes Written": written}}
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage_id, "Task Info": {"Index": index}, "Task Metrics": metrics}


def plan(spark, tmp_path, *events, **options):
    path = tmp_path / "log"
    path.write_text("\n".join(json.dumps(e) for e in ({"Event": "SparkListenerLogStart"}, *events)) + "\nnot json\n")
    return [(r["adaptive_point"], r["action"], r["arg"]) for r in tuning.analyze(spark, str(path), **options).orderBy("adaptive_point", "seq").collect()]


def one(spark, tmp_path, tasks):
    return plan(spark, tmp_path, stage(0, 0, "adaptive-x", len(tasks)), *tasks)[0][1:]


@pytest.mark.parametrize(
    "tasks,expected",
    [
        ([task(0, i, read=int(i > 0)) for i in range(4)], ("act-unp", "3")),
        ([task(0, i, read=0) for i in range(4)], ("act-unp", "1")),
        ([task(0, i, spilled=100, written=25) for i in range(4)], ("act-unp", "16")),
        ([task(0, i, gc=g) for i, g in enumerate((1, 1, 1, 10))], ("act-unp", "40")),
        ([task(0, i, run=r, read=n, bytes_=n) for i, (r, n) in enumerate(((10, 1), (10, 1), (10, 1), (100, 10)))], ("act-up", "rangePartitioner")),
        ([task(0, i, run=r, bytes_=b, read=n) for i, (r, b, n) in enumerate(((10, 10, 1), (10, 1, 10), (10, 10, 1), (100, 1, 10)))], ("act-wrn", tuning.INHERENT)),
        ([task(0, i, run=5) for i in range(4)], ("no-act", None)),
    ],
)
def test_policies(spark, tmp_path, tasks, expected):
    assert one(spark, tmp_path, tasks) == expected


def test_iterative_points(spark, tmp_path):
    regular = [e for k in range(2) for e in (stage(k, 10 * k, "p", 2), task(k, 0, read=0), task(k, 1, read=8))]
    assert plan(spark, tmp_path, *regular) == [("p", "act-unp", "1"), ("p", "act-unp", "1")]
    events = [stage(0, 0, "q", 4), *(task(0, i, read=2 * int(i > 0)) for i in range(4)), stage(1, 10, "q", 4), *(task(1, i, read=3) for i in range(4))]
    assert plan(spark, tmp_path, *events) == [("q", "act-unp", "3"), ("q", "act-unp", "6")]


def test_own_policy_and_thresholds(spark, tmp_path):
    events = [stage(0, 0, "r", 4), *(task(0, i, run=r) for i, r in enumerate((10, 10, 10, 30)))]
    assert plan(spark, tmp_path, *events, thresholds=tuning.Thresholds(skewness=1.5))[0][1] == "act-wrn"
    own = lambda t: tuning.action(tuning.WARN, "mine")
    assert plan(spark, tmp_path, *events, policies=(own,))[0][1] == "no-act"
    flat = tuning.Thresholds(measure_skew=lambda c: F.lit(9.0))
    assert plan(spark, tmp_path, *events, thresholds=flat)[0][1] == "act-wrn"
    compat = tuning.Thresholds(skewness=1.5, measure_correlation=defined_correlation)
    varied = [stage(0, 0, "r", 4), *(task(0, i, run=r, bytes_=i + 1, read=4 - i) for i, r in enumerate((10, 10, 10, 30)))]
    assert plan(spark, tmp_path, *varied, thresholds=compat)[0][1:] == ("act-up", "rangePartitioner")
    assert plan(spark, tmp_path, stage(0, 0, "plain", 1), task(0, 0), only_adaptive=True) == []


def test_text_and_scaling(spark):
    rows = [("b", 0, "act-unp", "3", 4), ("b", 1, "act-unp", "8", 9), ("a", 0, "no-act", None, 7)]
    assert tuning.plan_text(spark.createDataFrame(rows, "adaptive_point string, seq int, action string, arg string, stage_id long")) == "act-unp,b,3;act-unp,b,8;no-act,a"


def test_points_and_regular(spark, tmp_path):
    """Two stages of one RDD: that with more RDDs speaks; a point is regular while one instance's reads contain the other's."""
    events = [stage(0, 0, "p", 2, 1), task(0, 0, read=5), stage(1, 0, "p", 6, 3), task(1, 0, read=0), stage(2, 10, "p", 2, 1), task(2, 0, read=5)]
    events[2]["Stage Info"]["Stage Name"] = "wide"
    path = tmp_path / "log"
    path.write_text("\n".join(json.dumps(e) for e in events))
    found = tuning.points(tuning.stage_stats(*readers.read_event_log(spark, str(path)))).collect()
    assert [(r["point"], r["iterative"], r["regular"], [i["main"]["stage_id"] for i in r["instances"]]) for r in found] == [("p", True, True, [1, 2])]
    assert [(r["adaptive_point"], r["action"], r["arg"]) for r in tuning.analyze(spark, str(path)).orderBy("seq").collect()] == [("p", "act-unp", "5")] * 2


def test_own_event_log(spark, tmp_path):
    path = tmp_path / "log2"
    path.write_text(json.dumps(stage(3, 1, "z", 1)) + "\n" + json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Info": {"Index": 0}}) + "\n")
    stages, rdds, tasks = readers.read_event_log(spark, str(path))
    row = tasks.first()
    assert row["run_time"] == 0 and row["memory_spilled"] is None and stages.count() == 1 and rdds.count() == 1


def test_equal_values_do_not_correlate(spark):
    """49 equal values in each of two partitions: 1 / 49 * 49 < 1, so their merged deviation is above 0 by rounding."""
    rows = spark.range(0, 98, 1, 2).selectExpr("id AS a", "1 AS b", "2 * id AS c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    found = rows.agg(correlation(a, b), correlation(b, a), defined_correlation(a, b), defined_correlation(b, a), F.round(correlation(a, c), 9), defined_correlation(a, c)).first()
    assert tuple(found) == (0.0, 0.0, 0.0, 0.0, 1.0, 1.0)
