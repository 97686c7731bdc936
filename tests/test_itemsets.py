from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions.support import min_count
from quarryline.operators import itemsets
from quarryline.sources import readers, writers

LINES = ["2 1", "3 1 2 5", "1 6", "3 4 1", "3 4 2", "7 3 1", "5 4 2 1"]


def brute(transactions, count):
    found = {}
    for t in transactions:
        for k in range(1, len(set(t)) + 1):
            for s in combinations(sorted(set(t)), k):
                found[s] = found.get(s, 0) + 1
    return {s: n for s, n in found.items() if n > count}


def sets(df):
    rows = [(tuple(r["items"]), r["support"]) for r in df.collect()]
    assert len(rows) == len({s for s, _ in rows})
    return dict(rows)


def frame(spark, transactions):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(transactions)], "tid long, items array<int>")


@pytest.mark.parametrize("min_support", [0.0001, 0.3, 3 / 7, 0.5, 1.0])
def test_fixture_all_miners(spark, text, min_support):
    t = readers.read_transactions(spark, text(*LINES))
    expected = brute([[int(x) for x in line.split()] for line in LINES], min_count(min_support, 7))
    assert sets(itemsets.eclat(t, min_support)) == expected
    assert sets(itemsets.twidd(t, min_support)) == expected
    assert sets(itemsets.pfp(t, min_support, strict=True)) == expected


def test_known_numbers(spark, text):
    t = readers.read_transactions(spark, text(*LINES))
    assert sets(itemsets.eclat(t, 0.3)) == {(1,): 6, (2,): 4, (3,): 4, (4,): 3, (1, 2): 3, (1, 3): 3}
    assert itemsets.eclat(t, 0.0001).count() == 32
    assert itemsets.pfp(t, 3 / 7).count() == 6


@pytest.mark.parametrize("mu,expected", [(2, {(1,): 5, (2,): 4, (3,): 4, (4,): 3, (1, 2): 3, (1, 3): 3}), (3, {(1,): 3, (2,): 3, (3,): 3, (4,): 3})])
def test_mu_loss(spark, text, mu, expected):
    t = readers.read_transactions(spark, text(*LINES))
    assert sets(itemsets.twidd(t, 0.3, mu=mu, compat_mu_loss=True)) == expected


@pytest.mark.parametrize("mu,rho,partitions", [(0, 0, None), (1, 1, 3), (2, 3, 2), (3, 2, None)])
def test_knobs_do_not_matter(spark, text, mu, rho, partitions):
    t = readers.read_transactions(spark, text(*LINES))
    assert sets(itemsets.twidd(t, 0.2, mu, rho, partitions=partitions)) == brute([[int(x) for x in line.split()] for line in LINES], 1)


def test_lenient_parsing(spark, text):
    path = text("1 x 2", " 1 2", "2147483648 1", "", "1.5 +3 -4 5L 1e2")
    t = readers.read_transactions(spark, path)
    assert [r["items"] for r in t.orderBy("tid").collect()] == [[1, 2], [1, 2], [1], [], [3, -4]]
    assert t.count() == 5
    assert readers.parsing_issues(spark, path).first().asDict() == {"lines": 5, "issues": 5}


def test_multiset(spark, text):
    t = readers.read_transactions(spark, text("3 3 1", "3 1", "3 3"))
    assert sets(itemsets.eclat(t, 0.0, multiset=True)) == {(3,): 5, (1,): 2, (1, 3): 2}
    assert sets(itemsets.eclat(t, 0.0)) == {(3,): 3, (1,): 2, (1, 3): 2}
    with pytest.raises(Exception, match="unique"):
        itemsets.pfp(t, 0.1).collect()


def test_empty(spark):
    t = frame(spark, [])
    for miner in (itemsets.eclat, itemsets.twidd):
        assert sets(miner(t, 0.5)) == {}
    assert sets(itemsets.pfp(t, 0.5, strict=True)) == {}
    assert sets(itemsets.eclat(frame(spark, [[], []]), 0.0)) == {}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), min_size=1, max_size=12), st.integers(1, 3), st.integers(1, 3))
def test_against_brute_force(spark, transactions, mu, rho):
    t = frame(spark, transactions)
    count = min_count(0.25, len(transactions))
    expected = brute(transactions, count)
    assert sets(itemsets.eclat(t, 0.25)) == expected
    assert sets(itemsets.twidd(t, 0.25, mu, rho)) == expected


def test_threshold_is_cut_in_double_precision():
    assert min_count(0.29, 100) == 28
    assert min_count(0.3, 7) == 2


def test_tid_lists(spark):
    t = frame(spark, [[1, 2], [2, 2], [1]])
    got = {r["item"]: r["tids"] for r in itemsets.tid_lists(t).collect()}
    assert got == {1: [0, 2], 2: [0, 1, 1]}
    df = spark.createDataFrame([([1, 1, 2, 5], [1, 1, 1, 5, 7])], "a array<long>, b array<long>")
    assert df.select(itemsets.intersect_sorted(F.col("a"), F.col("b")).alias("x")).first()["x"] == [1, 1, 5]


def test_prefix_self_join(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 3],), ([1, 4],), ([2, 3],)], "items array<int>")
    assert sorted(r["items"] for r in itemsets.prefix_self_join(df).collect()) == [[1, 2, 3], [1, 2, 4], [1, 3, 4]]


def test_order(spark):
    df = spark.createDataFrame([([2], 1), ([1, 2], 1), ([1], 1)], itemsets.SETS)
    assert [r["items"] for r in itemsets.in_order(df).collect()] == [[1], [2], [1, 2]]


def test_writers(spark, text, tmp_path):
    found = itemsets.eclat(readers.read_transactions(spark, text(*LINES)), 0.3)
    writers.write_itemsets(found, str(tmp_path / "a"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "a")).collect()) == ["1 6", "1,2 3", "1,3 3", "2 4", "3 4", "4 3"]
    writers.write_itemset_levels(found, str(tmp_path / "b"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "b" / "level=2")).collect()) == ["1,2 3", "1,3 3"]


@pytest.mark.parametrize("rho", [1, 2])
def test_twidd_splits_large_groups(spark, monkeypatch, rho):
    """Groups of more than one path are split by their next items, again and again; the sets are those of eclat."""
    rows = [(1, 2, 3, 4), (1, 2, 3), (2, 3, 4), (1, 3, 4, 5), (1, 2, 4, 5), (2, 5), (1, 2, 3, 4, 5), (3,), ()]
    df = spark.createDataFrame([(list(r),) for r in rows], "items array<int>")
    expected = {(tuple(r["items"]), r["support"]) for r in itemsets.eclat(df, 0.12).collect()}
    monkeypatch.setattr(itemsets, "GROUP_PATHS", 1)
    found = [(tuple(r["items"]), r["support"]) for r in itemsets.twidd(df, 0.12, rho=rho).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_tid_lists_in_parts(spark):
    df = spark.createDataFrame([(i, [1, 2] if i % 2 else [1, 1]) for i in range(25)], "tid long, items array<int>")
    parts = {(r["item"], r["part"]): r["tids"] for r in itemsets.tid_lists(df, chunk=10).collect()}
    assert parts[2, 1] == [11, 13, 15, 17, 19] and parts[1, 2] == [20, 20, 21, 22, 22, 23, 24, 24] and len(parts) == 6


def test_tree_statistics(spark):
    """The prefix tree of 1 2 3, 1 2, 1 4 and 5 has five nodes."""
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([1, 4],), ([5],)], "items array<int>")
    assert tuple(itemsets.tree_statistics(df).first()) == (5, 3)
    assert tuple(itemsets.tree_statistics(df.limit(0)).first()) == (0, 0)


def test_pair_intersections(spark):
    df = spark.createDataFrame([(1, [1, 1, 2, 2]), (2, [1, 2]), (3, [3])], "tid long, items array<int>")
    rows = lambda **o: sorted(map(tuple, itemsets.pair_intersections(df, **o).collect()))
    assert rows() == [(1, 2, 2), (1, 3, 0), (2, 3, 0)] and rows(multiset=True) == [(1, 2, 3), (1, 3, 0), (2, 3, 0)]
