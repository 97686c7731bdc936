from quarryline.operators import keystats
from quarryline.sources import readers, writers


def test_bytes_per_key(spark, text, tmp_path):
    df = readers.read_key_bytes(spark, text("a b 10", "ab 5", "c 1"))
    stats = keystats.bytes_per_key(df)
    assert sorted(map(tuple, stats.collect())) == [("ab", 2, 15), ("c", 1, 1)]
    assert sorted(r["key"] for r in readers.read_key_bytes(spark, text("a b 10", name="other.txt"), " ").collect()) == ["a b"]
    writers.write_key_bytes(stats, str(tmp_path / "out*"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out.agg")).collect()) == ["ab\t2\t15", "c\t1\t1"]


def test_many_files(spark, text):
    a, b = text("x 1", name="a.txt"), text("x 2", name="b.txt")
    df = keystats.bytes_per_key(readers.read_key_bytes(spark, f"{a};{b}"), by=("file",))
    assert sorted(r["bytes"] for r in df.collect()) == [1, 2]


def test_key_sort(spark, text, tmp_path):
    lines = spark.read.text(text("b", "a", "10", "9", "b")).withColumnRenamed("value", "key")
    counts = keystats.sorted_key_counts(lines)
    assert [tuple(r) for r in counts.collect()] == [("10", 1), ("9", 1), ("a", 1), ("b", 2)]
    writers.write_key_counts(counts, str(tmp_path / "sorted"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sorted")).collect()] == ["10 1", "9 1", "a 1", "b 2"]


def test_key_tree(spark, text, tmp_path):
    text("k1", "k2", name="keydist/app1/s0/d0/part-0")
    text("k3", "k4", name="keydist/app1/s0/d1/part-0")
    text("k1", name="keydist/app2/s0/d0/part-0")
    root = str(tmp_path / "keydist")
    every = readers.read_key_tree(spark, root)
    assert every.count() == 5
    some = readers.read_key_tree(spark, root, skip_equal_sizes=True)
    assert sorted(r["key"] for r in some.collect()) == ["k1", "k1", "k2"]
    assert writers.aggregated_path(root).endswith("keydist-aggregated")


def test_samples(spark):
    rows = spark.range(2000)
    assert keystats.bernoulli_sample(rows, 0.1, 1).collect() == keystats.bernoulli_sample(rows, 0.1, 1).collect()
    n = keystats.hash_sample(rows, rows["id"], 10).count()
    assert n == keystats.hash_sample(rows.repartition(7), rows["id"], 10).count() and 120 < n < 280
