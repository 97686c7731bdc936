"""K-means with given, random or parallel (k-means||) initial centers.

Lloyd's rounds send the centers (k vectors) to the executors; each batch of
points is assigned by array operations and reduced to one sum, count and cost
per cluster before anything is shuffled.  A center without points stays; among
equally near centers the first wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm

INIT_MODES = ("random", "k-means||")


@dataclass(frozen=True)
class KMeansResult:
    """Centers (k x dimensions), the sum of squared distances to them, rounds done, and whether every center had settled."""

    centers: np.ndarray
    cost: float
    rounds: int
    converged: bool


def _points(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("points have different numbers of dimensions")
    return flat.reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center and the squared distance to it, computed by differences (ties are exact)."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, c in enumerate(centers):
        d = ((x - c) ** 2).sum(1)
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at, best


def _sums(points: DataFrame, centers: np.ndarray, x: str, partitions: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, numbers and cost of the centers' points; ``partitions``: how many tasks merge the partial sums."""
    k, dims = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = np.zeros((k, dims)), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                p = _points(batch.column(0))
                at, d = _nearest(p, centers)
                np.add.at(total, at, p)
                count += np.bincount(at, minlength=k)
                cost += np.bincount(at, weights=d, minlength=k)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(cost[own]), pa.array(total[own].tolist(), pa.list_(pa.float64()))], ["cluster", "n", "cost", "total"])

    parts = points.select(x).mapInArrow(run, "cluster int, n long, cost double, total array<double>")
    each = parts.select("cluster", "n", "cost", F.posexplode("total").alias("i", "v"))
    if partitions and partitions > 0:
        each = each.repartition(partitions, "cluster", "i")
    merged = each.groupBy("cluster", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    total, count, cost = np.zeros((k, dims)), np.zeros(k, np.int64), 0.0
    for r in merged.collect():  # k x dimensions rows
        total[r["cluster"], r["i"]], count[r["cluster"]] = r["v"], r["n"]
        cost += r["cost"] if r["i"] == 0 else 0.0
    return total, count, cost


def lloyd(points: DataFrame, centers: list[list[float]] | np.ndarray, max_iter: int = 20, epsilon: float = 1e-4, x: str = "x", partitions: int | None = None) -> KMeansResult:
    """Rounds from given centers until none moves further than ``epsilon``."""
    centers = np.array(centers, np.float64)
    rounds, converged = 0, False
    while rounds < max_iter and not converged:
        total, count, _ = _sums(points, centers, x, partitions)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        converged = bool((((new - centers) ** 2).sum(1) <= epsilon**2).all())
        centers, rounds = new, rounds + 1
    return KMeansResult(centers, _sums(points, centers, x, partitions)[2], rounds, converged)


def assign(points: DataFrame, centers: np.ndarray, x: str = "x") -> DataFrame:
    """The points with ``cluster int`` and ``distance2 double``."""
    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = _nearest(_points(batch.column(batch.schema.get_field_index(x))), centers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(d)], [*batch.schema.names, "cluster", "distance2"])

    return points.mapInArrow(run, schema)


def random_centers(points: DataFrame, k: int, seed: int = 1, x: str = "x") -> np.ndarray:
    """k distinct points in the order of a seeded hash; the same for every partitioning. Equal points are told apart last, so only the smallest hashes are gathered."""
    hashed = points.select(F.col(x).alias("x"), F.xxhash64(F.col(x), F.lit(seed)).alias("h"))
    least = hashed.groupBy("h").agg(F.lit(1)).orderBy("h").limit(k).select("h")  # hashes, not vectors
    rows = hashed.join(F.broadcast(least), "h", "left_semi").distinct().orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.float64)


def _chance(id_col: Column, step: int, seed: int) -> Column:
    """A number from 0 to 1 for a point and step: eight hexadecimal digits of a seeded MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{step}:"), id_col.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def parallel_candidates(points: DataFrame, k: int, steps: int = 5, seed: int = 1, id_col: Column | None = None, x: str = "x") -> DataFrame:
    """``candidate int, center array<double>, weight long``: k-means||. After one point by chance, each step takes points with probability 2k times their share of the cost; weights count the points nearest to each.

    ``id_col`` tells points apart (else their values do, so equal points share a chance).
    """
    spark = points.sparkSession
    known = points.select((F.col(x).cast("string") if id_col is None else id_col.cast("string")).alias("id"), F.col(x).alias("x"))
    first = known.orderBy(_chance(F.col("id"), 0, seed), F.length("id"), "id").limit(1).collect()
    centers = [[float(v) for v in r["x"]] for r in first]
    for step in range(1, steps + 1 if centers else 0):
        costed = assign(known, np.array(centers))
        total = costed.agg(F.sum("distance2").alias("c")).first()["c"] or 0.0
        if not total:
            break
        chosen = costed.where(_chance(F.col("id"), step, seed) < F.lit(2.0 * k) * F.col("distance2") / F.lit(total)).orderBy(F.length("id"), "id").select("x").collect()  # about 2 k points
        centers += [[float(v) for v in r["x"]] for r in chosen]
    if not centers:
        return spark.createDataFrame([], "candidate int, center array<double>, weight long")
    _, count, _ = _sums(known, np.array(centers), "x")
    return spark.createDataFrame([(i, c, int(n)) for i, (c, n) in enumerate(zip(centers, count, strict=True))], "candidate int, center array<double>, weight long")


def _weighted_centers(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """k of weighted candidates by k-means++, then at most ``rounds`` of Lloyd's rounds among the candidates (few vectors, on the driver)."""
    x, at = np.unique(x, axis=0, return_inverse=True)
    weight = np.bincount(at.reshape(-1), weights=weight)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
    while len(chosen) < k:
        share = weight * _nearest(x, x[chosen])[1]
        rest = [i for i in range(len(x)) if i not in chosen]
        chosen.append(int(rng.choice(len(x), p=share / share.sum())) if share.sum() else rest[0])
    centers = x[chosen]
    for _ in range(rounds):
        own, _ = _nearest(x, centers)
        new = centers.copy()
        for c in range(k):
            if (mine := own == c).any() and weight[mine].sum():
                new[c] = np.average(x[mine], axis=0, weights=weight[mine])
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def parallel_centers(points: DataFrame, k: int, steps: int = 5, seed: int = 1, x: str = "x") -> np.ndarray:
    """Initial centers by k-means||; fewer than k if there are fewer different points."""
    rows = parallel_candidates(points, k, steps, seed, x=x).collect()
    return _weighted_centers(np.array([r["center"] for r in rows], np.float64), np.array([r["weight"] for r in rows], np.float64), k, seed) if rows else np.zeros((0, 0))


def kmeans(points: DataFrame, k: int = 2, max_iter: int = 20, init_mode: str = "k-means||", init_steps: int = 5, epsilon: float = 1e-4, seed: int = 1, initial: np.ndarray | None = None, runs: int = 1, partitions: int | None = None, x: str = "x") -> KMeansResult:
    """Trains with the given centers or an initial mode; of several runs the cheapest is kept. ``partitions``: how many tasks merge the sums of a round."""
    if initial is not None:
        if len(initial) != k:
            raise ValueError(f"{len(initial)} initial centers were given for k = {k}")
        return lloyd(points, initial, max_iter, epsilon, x, partitions)
    if init_mode not in INIT_MODES:
        raise ValueError(f"init_mode is one of {INIT_MODES}, not {init_mode!r}")
    if k < 1 or max_iter < 0 or runs < 1 or init_steps < 1:
        raise ValueError("k, runs and init_steps must be positive, max_iter must not be negative")
    begin = lambda r: random_centers(points, k, seed + r, x) if init_mode == "random" else parallel_centers(points, k, init_steps, seed + r, x)
    return min((lloyd(points, begin(r), max_iter, epsilon, x, partitions) for r in range(runs)), key=lambda m: m.cost)


def compute_cost(points: DataFrame, centers: np.ndarray, x: str = "x") -> float:
    return _sums(points, np.asarray(centers, np.float64), x)[2]


def with_norms(points: DataFrame, x: str = "x") -> DataFrame:
    return points.withColumn("norm", norm(F.col(x)))


def model_frame(result: KMeansResult, spark) -> DataFrame:
    """``cluster int, center array<double>``."""
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(result.centers)], "cluster int, center array<double>")
