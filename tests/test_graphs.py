import pytest

from quarryline.operators import pagerank
from quarryline.operators.components import connected_components
from quarryline.plans import catalog
from quarryline.sources import readers

ADJACENCY = ["1 2 3", "2 3", "3 1", "4 1 3", "5 9"]


def ranks(df):
    return {r["id"]: round(r["rank"], 6) for r in df.collect()}


@pytest.mark.parametrize(
    "rounds,expected",
    [
        (0, {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}),
        (1, {1: 1.425, 2: 0.575, 3: 1.85, 9: 1.0}),
        (2, {1: 1.7225, 2: 0.755625, 3: 1.244375}),
        (10, {1: 1.246719, 2: 0.683240, 3: 1.266915}),
    ],
)
def test_adjacency_pagerank(spark, text, rounds, expected):
    path = text(*ADJACENCY)
    assert ranks(pagerank.adjacency_pagerank(readers.read_adjacency_edges(spark, path), rounds)) == pytest.approx(expected)
    assert ranks(pagerank.adjacency_pagerank_by_line(readers.read_adjacency_rows(spark, path), rounds)) == pytest.approx(expected)


def test_repeated_source(spark, text):
    path = text("1 2", "1 3", "2 1", "3 1")
    assert ranks(pagerank.adjacency_pagerank_by_line(readers.read_adjacency_rows(spark, path), 1)) == pytest.approx({1: 1.85, 2: 1.85, 3: 1.85})
    assert ranks(pagerank.adjacency_pagerank(readers.read_adjacency_edges(spark, path), 1)) == pytest.approx({1: 1.85, 2: 0.575, 3: 0.575})


def test_keep_sources(spark, text):
    got = ranks(pagerank.adjacency_pagerank(readers.read_adjacency_edges(spark, text(*ADJACENCY)), 1, keep_sources=True))
    assert got == pytest.approx({1: 1.425, 2: 0.575, 3: 1.85, 9: 1.0, 4: 0.15, 5: 0.15})


def test_graph_pagerank(spark, text):
    edges = readers.read_graph(spark, text(*ADJACENCY), "adjLists")
    got = ranks(pagerank.graph_pagerank(edges, 1))
    assert got == pytest.approx({1: 1.425, 2: 0.575, 3: 1.85, 4: 0.15, 5: 0.15, 9: 1.0})
    assert pagerank.vertices(edges).count() == 6
    assert ranks(pagerank.graph_pagerank(edges, 1, reset_prob=0.0001))[4] == 0.0001


def test_components(spark, text):
    edges = readers.read_graph(spark, text("# a comment", "1 2", "", "2 3", "5 4"), "edges")
    assert {r["id"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


@pytest.mark.parametrize("hub_rows", [100, 1_000_000])
def test_components_hub(spark, hub_rows):
    """A vertex that holds every edge, as the largest and as the smallest id, and one that joins two hubs; with and without salts."""
    edges = spark.createDataFrame([(i, 9999) for i in range(1, 3000)] + [(10_000, i) for i in range(10_001, 13_000)] + [(20_000, i) for i in range(20_001, 20_010)] + [(9999, 12_999)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges, hub_rows=hub_rows).collect()}
    assert got == {**dict.fromkeys([*range(1, 3000), 9999, *range(10_000, 13_000)], 1), **dict.fromkeys(range(20_000, 20_010), 20_000)}


def test_components_long_path_loops_and_nulls(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 5), (7, 7), (2000, 2001), (2001, 2000)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 2000: 2000, 2001: 2000}
    assert connected_components(edges.limit(0)).count() == 0


def test_whole_graph_queries(spark, tmp_path):
    """Every lineitem row is an edge, whatever its line number and quantity; checked with a union-find."""
    rows = [(o, o * 7 % 30 + j, j + 1, float(j * 9 + 1)) for o in range(1, 60) for j in range(o % 5)] + [(1000, 2000, 7, 1.0), (1000, 2001, 3, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, p, _, _ in rows:
        a, b = find(2 * o), find(2 * p + 1)
        parent[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in parent}
    got = catalog.QUERIES["components"](spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {r["id"]: r["component"] for r in got} == expected
    sizes = {c: list(expected.values()).count(c) for c in expected.values()}
    assert {r["component"]: r["n"] for r in catalog.QUERIES["component_sizes"](spark, str(tmp_path)).collect()} == sizes and max(sizes.values()) > 20
    assert tuple(catalog.QUERIES["graph_counts"](spark, str(tmp_path)).first()) == (len(expected), len(sizes))


@pytest.mark.parametrize("line", ["1 x", "1"])
def test_bad_edge(spark, text, line):
    with pytest.raises(Exception, match="not a"):
        readers.read_edges(spark, text("1 2", line)).collect()


@pytest.mark.parametrize("line", ["", " 1 2", "1 2.5"])
def test_bad_adjacency(spark, text, line):
    with pytest.raises(Exception, match="not a line"):
        readers.read_adjacency_edges(spark, text("1 2", line)).collect()


def test_unknown_kind(spark, text):
    with pytest.raises(ValueError, match="edges"):
        readers.read_graph(spark, text("1 2"), "other")
