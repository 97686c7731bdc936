"""Uniform random sharding with exact sizes by a hypergeometric communication matrix.

How many rows of each partition go to each shard of a uniformly shuffled table
follows a multivariate hypergeometric law.  These exact counts are drawn first;
then each partition permutes its rows and deals them out by the counts, the
rows are exchanged, and each receiver permutes again.  Shard sizes differ by at
most one row, and every arrangement is equally likely.

Nobody holds the whole matrix (partitions x cells).  The partitions are the
leaves of a binary tree; each node splits the room left in the cells between
its halves with a generator seeded by the node, so a task draws its own row by
walking from the root (cells x log2(partitions) draws), and all tasks agree.
A large shard consists of several cells, so no task receives a whole shard.

Rows are written once with their numbers; permutations are orders by seeded
hashes of key and number, not by arrival, so a task that runs again after an
executor was lost deals its rows as before, and rows that are alike are
shuffled like any other.  A task that deals a partition meets its rows sorted
and needs only its own row of the matrix.

Defined results: rows without a key (null ids), null, empty and very long
texts are dealt like any other; of repeated rows each is dealt on its own; an
empty table gives no rows; ``assign_shards`` keeps further columns of any name
and replaces columns named ``shard`` and ``slot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .common import fresh, table

N_SHARDS = 16
SEED = 20_240_607
#: Rows that one receiving task permutes at most.
ROWS_PER_CELL = 250_000
#: Populations from which numpy draws hypergeometric numbers itself.
_LIBRARY_MOST = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad; also for populations that numpy's generator refuses."""
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good + bad < _LIBRARY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    mean = draws * good / total
    sd = max(1.0, np.sqrt(mean * (bad / total) * ((total - draws) / max(1, total - 1))))
    # beyond 12 standard deviations the mass is below 1e-30
    a, b = max(lo, int(mean - 12 * sd) - 2), min(hi, int(mean + 12 * sd) + 2)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def split_room(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``draws`` places from the cells' room."""
    out = np.zeros_like(room)
    rest = int(room.sum())
    for i, n in enumerate(room.tolist()):
        if not draws:
            break
        rest -= n
        out[i] = hypergeometric(rng, n, rest, draws)
        draws -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, room: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix; ``counts``: rows of each partition, ``room``: of each cell."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, node = 0, len(counts), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_room(np.random.default_rng([seed, node]), room, int(upto[mid] - upto[lo]))
        if partition < mid:
            room, hi, node = left, mid, 2 * node
        else:
            room, lo, node = room - left, mid, 2 * node + 1
    return room


def cell_sizes(n_rows: int, n_shards: int, rows_per_cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all cells, and the shard of each: shards differ by at most one row, as do the cells of a shard."""
    sizes, shards = [], []
    for s in range(n_shards):
        n = n_rows // n_shards + (s < n_rows % n_shards)
        k = max(1, -(-n // rows_per_cell))
        sizes += [n // k + (i < n % k) for i in range(k)]
        shards += [s] * k
    return np.array(sizes, np.int64), np.array(shards, np.int64)


def assign_shards(df: DataFrame, key: list[Column], n_shards: int = N_SHARDS, seed: int = SEED, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``df`` with ``shard int`` and ``slot long``: the row's place in its shard, from 0 without gaps.

    ``key`` is mixed into the permutations.  The table is written once with a
    number for each row, since a plan that runs again may deal rows to other
    partitions; the number also tells rows apart that agree in the key.
    """
    spark = df.sparkSession
    row, part, first, again, cell, base = fresh([*df.columns, "shard", "slot"], "row", "part", "first", "again", "cell", "base")
    hashed = df.withColumn(row, F.monotonically_increasing_id()).withColumn(first, F.xxhash64(F.lit(seed), *key, F.col(row))).withColumn(again, F.xxhash64(F.lit(seed + 1), *key, F.col(row)))
    held = materialize(hashed.withColumn(part, F.shiftright(row, 33).cast("int")).drop("shard", "slot"), "sharding")
    told = held.groupBy(part).count().orderBy(part).toArrow()  # two numbers for each partition
    parts, counts = told.column(part).to_numpy(), told.column("count").to_numpy().astype(np.int64)
    sizes, shards = cell_sizes(int(counts.sum()), n_shards, rows_per_cell)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = starts - starts[np.searchsorted(shards, shards)]  # of a cell in its shard
    shared = spark.sparkContext.broadcast((parts, counts, sizes, shards, offset))  # numbers of partitions and cells, not rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by partition and hash get the cell whose share of the partition their rank lies in."""
        parts, counts, sizes, shards, offset = shared.value
        now, rank, upto = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(part).to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
            cells = np.empty(len(p), np.int64)
            for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                if p[a] != now:
                    now, rank = p[a], 0
                    upto = np.cumsum(matrix_row(counts, sizes, int(np.searchsorted(parts, now)), seed))
                cells[a:b] = np.searchsorted(upto, np.arange(rank, rank + b - a), "right")
                rank += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(offset[cells], pa.int64()), pa.array(shards[cells], pa.int32())], [*batch.schema.names, cell, base, "shard"])

    schema = T.StructType([*held.schema.fields, T.StructField(cell, T.LongType()), T.StructField(base, T.LongType()), T.StructField("shard", T.IntegerType())])
    dealt = held.repartition(max(1, len(parts)), part).sortWithinPartitions(part, first, row).mapInArrow(deal, schema)
    place = Window.partitionBy(cell).orderBy(again, row)
    placed = dealt.repartition(2 * len(sizes), cell).withColumn("slot", F.row_number().over(place).cast("long") - 1 + F.col(base))
    return placed.drop(row, part, first, again, cell, base)


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = assign_shards(docs, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
