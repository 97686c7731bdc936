import numpy as np
import pytest

from quarryline.operators import kmeans
from quarryline.sources import readers

POINTS = ["0 0.0 0.0", "1 0.0 1.0", "2 10.0 10.0", "3 10.0 11.0"]


def test_given_centers(spark, text):
    p = readers.read_points(spark, text(*POINTS))
    m = kmeans.kmeans(p, 2, initial=[[0, 0], [10, 10]])
    assert m.centers.tolist() == [[0, 0.5], [10, 10.5]]
    assert m.cost == 1.0 and m.converged
    assert kmeans.compute_cost(p, m.centers) == 1.0
    assert sorted(r["cluster"] for r in kmeans.assign(p, m.centers).collect()) == [0, 0, 1, 1]
    assert kmeans.model_frame(m, spark).count() == 2


def test_empty_cluster_stays(spark, text):
    m = kmeans.kmeans(readers.read_points(spark, text(*POINTS)), 3, initial=[[0, 0], [10, 10], [100, 100]])
    assert m.centers[2].tolist() == [100, 100]


def test_first_of_equal_centers_wins(spark, text):
    p = readers.read_points(spark, text(*POINTS))
    assert {r["cluster"] for r in kmeans.assign(p, np.array([[5.0, 5.0], [5.0, 5.0]])).collect()} == {0}


@pytest.mark.parametrize("mode", kmeans.INIT_MODES)
def test_modes(spark, text, mode):
    m = kmeans.kmeans(readers.read_points(spark, text(*POINTS)), 2, init_mode=mode, runs=2)
    assert m.cost == pytest.approx(1.0)


def test_cost_does_not_rise(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(x.tolist(),) for x in rng.normal(size=(200, 3))], "x array<double>")
    start = kmeans.random_centers(p, 4)
    costs = [kmeans.lloyd(p, start, n, 0.0).cost for n in range(4)]
    assert costs == sorted(costs, reverse=True)


def test_errors(spark, text):
    p = readers.read_points(spark, text(*POINTS))
    with pytest.raises(ValueError, match="init_mode"):
        kmeans.kmeans(p, 2, init_mode="other")
    with pytest.raises(ValueError, match="initial centers"):
        kmeans.kmeans(p, 3, initial=[[0, 0]])
    for bad in ("1  2.0 3.0", " 1.0 2.0", "", "1 x y"):
        with pytest.raises(Exception, match="not a"):
            readers.read_points(spark, text(*POINTS, bad)).collect()
    with pytest.raises(Exception, match="dimensions"):
        kmeans.kmeans(readers.read_points(spark, text(*POINTS, "9 1.0")), 2, initial=[[0, 0], [1, 1]])


def test_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "x array<double>")
    assert kmeans.with_norms(df).first()["norm"] == 5.0
