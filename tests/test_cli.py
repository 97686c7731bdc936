import pytest

from quarryline import cli


def test_commands(spark, text, tmp_path):
    baskets = text("2 1", "3 1 2 5", "1 6", "3 4 1", "3 4 2", "7 3 1", "5 4 2 1")
    for name in ("eclat", "twidd"):
        assert cli.run(spark, [name, baskets, "--min-support", "0.3"]).count() == 6
    assert cli.run(spark, ["pfp", baskets, "--min-support", "0.3", "--strict", "--output", str(tmp_path / "pfp")]).count() == 6
    assert "{1}: 6" in [r["value"] for r in spark.read.text(str(tmp_path / "pfp")).collect()]
    graph = text("1 2 3", "2 3", "3 1", name="graph.txt")
    assert cli.run(spark, ["pagerank", graph, "--rounds", "2"]).count() == 3
    assert cli.run(spark, ["components", graph, "--kind", "adjLists"]).count() == 3
    assert cli.run(spark, ["kmeans", text("0 0.0", "1 9.0", name="points.txt"), "--k", "2"]).count() == 2
    cli.run(spark, ["sample", baskets, "--fraction", "1.0", "--seed", "3"])
    assert spark.read.text(f"{baskets}-1.0-3.sample").count() == 7
    assert cli.run(spark, ["key-bytes", text("a 1", "a 2", name="kb.txt")]).first()["bytes"] == 3


def test_usage():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["eclat"])
