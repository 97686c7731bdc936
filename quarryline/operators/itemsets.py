"""Frequent itemset mining.

Transactions are rows with ``items array<int>``.  A set is frequent if it
occurs in more than ``int(min_support * N)`` transactions, N counting every
row, also those without items.  Results are ``items array<int>`` (ascending)
and ``support long``.

Three miners give the same sets: ``eclat`` (level by level), ``twidd``
(projections balanced by prefixes) and ``pfp`` (the library's FP-growth, whose
own rule is ``support >= ceil(min_support * N)``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.support import at_least_fraction, min_count
from ..storage import materialize

SETS = "items array<int>, support long"
#: Candidate sets of a level that are sent to every executor, at most.
BROADCAST_SETS = 500_000
#: Frequent items up to this number are looked up within the row; more are joined.
IN_ROW_ITEMS = 2_000
#: Conditional paths of a set that one task mines; more are projected by one further item first.
GROUP_PATHS = 200_000


def baskets(pairs: DataFrame, tid: str = "tid", item: str = "item", distinct: bool = True) -> DataFrame:
    """Transactions from (tid, item) rows."""
    collected = F.collect_set(item) if distinct else F.collect_list(item)
    return pairs.groupBy(F.col(tid).alias("tid")).agg(collected.cast("array<int>").alias("items"))


def item_support(transactions: DataFrame, multiset: bool = False) -> DataFrame:
    """``item, support``; a repeated item counts once a transaction, or every time if ``multiset``."""
    items = F.col("items") if multiset else F.array_distinct("items")
    return transactions.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("support"))


def frequent_items(transactions: DataFrame, count: int, multiset: bool = False) -> DataFrame:
    """``item_support`` of items that occur more than ``count`` times."""
    return item_support(transactions, multiset).where(F.col("support") > count)


def tid_lists(transactions: DataFrame, frequent: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """``item, tids array<long>`` (ascending; a repeated item repeats the id), of frequent items if they are given.

    A common item's list may outgrow a row: with ``chunk`` there is a row, with ``part long``, for each range of so many ids.
    """
    rows = transactions.select("tid", F.explode("items").alias("item"))
    if frequent is not None:
        rows = rows.join(frequent.select("item"), "item", "left_semi")
    by = ["item"] if chunk is None else ["item", F.floor(F.col("tid") / chunk).cast("long").alias("part")]
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list("tid")).alias("tids"))


def intersect_sorted(a: Column, b: Column) -> Column:
    """Ids in both ascending lists; one that occurs m and n times stays min(m, n) times."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.flatten(F.transform(F.array_sort(F.array_intersect(a, b)), lambda x: F.array_repeat(x, F.least(times(a, x), times(b, x)))))


def prefix_self_join(frequent: DataFrame) -> DataFrame:
    """Candidates of the next level: ``items`` of two sets that agree in all but their last items. ``frequent``: sets of one size."""
    last = F.element_at("items", -1)
    sets = frequent.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("prefix"), last.alias("last"))
    a, b = sets.alias("a"), sets.alias("b")
    return a.join(b, (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.last") < F.col("b.last"))).select(F.concat("a.prefix", F.array("a.last", "b.last")).alias("items"))


def _only(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Rows whose items are among the sets; the sets are broadcast if they are few."""
    return rows.join(F.broadcast(sets) if n <= BROADCAST_SETS else sets, "items", "left_semi")


def _numbered(transactions: DataFrame) -> DataFrame:
    """A number for each transaction, given before its items are told apart."""
    return transactions.select(F.monotonically_increasing_id().alias("row"), "items")


def _occurrences(transactions: DataFrame, frequent: DataFrame, n_frequent: int, multiset: bool) -> DataFrame:
    """Distinct transactions reduced to frequent items, (item, times) in ascending order, and how often each occurs."""
    if n_frequent <= IN_ROW_ITEMS:
        known = F.lit([r["item"] for r in frequent.select("item").collect()]) if n_frequent else F.array().cast("array<int>")
        items = F.array_sort(F.array_intersect("items", known.cast("array<int>")))
        times = lambda x: F.size(F.filter("items", lambda y: y == x)).cast("long") if multiset else F.lit(1).cast("long")
        rows = transactions.select(F.transform(items, lambda x: F.struct(x.alias("item"), times(x).alias("times"))).alias("rest"))
        return rows.where(F.size("rest") > 0).groupBy("rest").agg(F.count("*").alias("n"))
    rows = _numbered(transactions).select("row", F.explode("items").alias("item"))
    rows = rows.join(frequent.select("item"), "item", "left_semi").groupBy("row", "item").agg(F.count("*").alias("times"))
    times = F.col("times") if multiset else F.lit(1).cast("long")
    return rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item", times.alias("times")))).alias("rest")).groupBy("rest").agg(F.count("*").alias("n"))


def _extend(rows: DataFrame, first: bool) -> DataFrame:
    """Every set of a row with each of the items behind its last one."""
    more = rows.select(*rows.columns, F.posexplode("rest").alias("at", "x"))
    new = F.array("x.item") if first else F.concat("items", F.array("x.item"))
    times = F.col("x.times") if first else F.least("times", "x.times")
    return more.select(new.alias("items"), times.alias("times"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n")


def eclat(transactions: DataFrame, min_support: float, multiset: bool = False, max_level: int | None = None, n: int | None = None) -> DataFrame:
    """Level-wise mining.

    Occurrences of sets carry the items behind their last one, so the next
    level is made within each row: transactions never move, only counts do.
    Candidates are joined from the frequent sets by prefix before they are
    counted.  ``multiset``: a set counts as often as its rarest item repeats.
    """
    spark = transactions.sparkSession
    count = min_count(min_support, transactions.count() if n is None else n)
    frequent = materialize(frequent_items(transactions, count, multiset), "items")
    found = [frequent.select(F.array("item").alias("items"), "support")]
    known = frequent.count()
    rows = _extend(_occurrences(transactions, frequent, known, multiset), True).where(F.size("rest") > 0)
    level, held = 1, None
    while known > 1 and (max_level is None or level < max_level):
        wider = _extend(rows, False)
        if level > 1:
            candidates = materialize(prefix_self_join(found[-1]), "candidates")
            wider = _only(wider, candidates, candidates.count())
        wider = wider.persist(StorageLevel.MEMORY_AND_DISK)
        sets = materialize(wider.groupBy("items").agg(F.sum(F.col("times") * F.col("n")).alias("support")).where(F.col("support") > count), "sets")
        known, level = sets.count(), level + 1
        if known:
            found.append(sets)
        rows = _only(wider, sets, known).where(F.size("rest") > 0)
        if held is not None:
            held.unpersist()
        held = wider
    if held is not None:
        held.unpersist()
    out = found[0]
    for sets in found[1:]:
        out = out.unionByName(sets)
    return out


def pfp(transactions: DataFrame, min_support: float, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """FP-growth of the ML library; repeated items in a transaction are an error.

    Its rule is ``support >= ceil(min_support * N)``; ``strict`` keeps what the other miners keep.
    """
    from pyspark.ml.fpm import FPGrowth

    if strict:
        n = transactions.count()
        count = min_count(min_support, n)
        if not n or count >= n:
            return transactions.sparkSession.createDataFrame([], SETS)
        min_support = at_least_fraction(count, n)
    options = {"numPartitions": partitions} if partitions else {}
    model = FPGrowth(itemsCol="items", minSupport=min_support, **options).fit(transactions)
    return model.freqItemsets.select(F.array_sort("items").cast("array<int>").alias("items"), F.col("freq").cast("long").alias("support"))


def by_frequency(transactions: DataFrame, frequent: DataFrame) -> DataFrame:
    """``items``: each transaction's distinct frequent items, most frequent first, then ascending; and ``w``, how many transactions are alike."""
    rows = _numbered(transactions).select("row", F.explode(F.array_distinct("items")).alias("item")).join(frequent, "item")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), F.col("item").alias("item")))), lambda x: x["item"])
    return rows.groupBy("row").agg(ordered.alias("items")).groupBy("items").agg(F.count("*").alias("w"))


def tree_statistics(ordered: DataFrame) -> DataFrame:
    """``nodes long, depth int`` of the prefix tree of ordered transactions: its distinct prefixes, and the longest."""
    prefixes = ordered.select(F.posexplode("items").alias("at", "x"), "items").select(F.expr("slice(items, 1, at + 1)").alias("prefix"))
    return prefixes.groupBy("prefix").agg(F.size("prefix").alias("n")).agg(F.count("*").alias("nodes"), F.coalesce(F.max("n"), F.lit(0)).alias("depth"))


def pair_intersections(transactions: DataFrame, multiset: bool = False) -> DataFrame:
    """``item_a, item_b, n``: in how many transactions two items meet (with ``multiset``: as often as the rarer repeats), also 0; items meet by transaction, so no list is built."""
    times = F.count("*").alias("times") if multiset else F.lit(1).cast("long").alias("times")
    rows = transactions.select("tid", F.explode("items").alias("item")).groupBy("tid", "item").agg(times)
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.tid") == F.col("b.tid")) & (F.col("a.item") < F.col("b.item"))).groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.sum(F.least("a.times", "b.times")).alias("n"))
    items = rows.select("item").distinct()
    every = items.select(F.col("item").alias("item_a")).join(items.select(F.col("item").alias("item_b")), F.col("item_a") < F.col("item_b"))  # the answer has these rows
    return every.join(met, ["item_a", "item_b"], "left").select("item_a", "item_b", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def project(rows: DataFrame) -> DataFrame:
    """Conditional transactions: each item of ``path`` joins the set, and the items before it are the new path."""
    more = rows.select("items", "w", F.col("path").alias("old"), F.posexplode("path").alias("at", "x"))
    return more.select(F.concat("items", F.array("x")).alias("items"), F.expr("slice(old, 1, at)").alias("path"), "w")


def grow(paths: list[tuple[tuple[int, ...], int]], count: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """FP-growth by projection of weighted paths: all sets within them that weigh more than ``count``."""
    weight: Counter = Counter()
    for path, w in paths:
        for x in path:
            weight[x] += w
    for x, w in weight.items():
        if w <= count:
            continue
        yield (x,), w
        inner: Counter = Counter()
        for path, v in paths:
            if x in path:
                inner[tuple(y for y in path[: path.index(x)] if weight[y] > count)] += v
        for more, v in grow([p for p in inner.items() if p[0]], count):
            yield (x, *more), v


def twidd(transactions: DataFrame, min_support: float, mu: int = 2, rho: int = 2, compat_mu_loss: bool = False, partitions: int | None = None) -> DataFrame:
    """Prefix-tree style mining with two balancing knobs that do not change the result.

    Equal ordered transactions are merged; ``mu`` deals them out by their first
    ``mu`` items (if a number of partitions is given).  Sets of up to ``rho``
    items are counted by projection, each level from the frequent sets of the one
    before; those of exactly ``rho`` items also carry their conditional paths,
    merged, from which each group is mined on its own.  Groups of more than
    ``GROUP_PATHS`` paths are split by their next items.

    ``compat_mu_loss``: transactions with fewer than ``mu`` frequent items are
    lost, as in implementations that drop them when they split their trees.
    """
    spark = transactions.sparkSession
    n = transactions.count()
    count = min_count(min_support, n)
    if not n or count >= n:
        return spark.createDataFrame([], SETS)
    frequent = materialize(frequent_items(transactions, count), "items")
    merged = by_frequency(transactions, frequent)
    if compat_mu_loss:
        merged = merged.where(F.size("items") >= mu)
    if partitions and mu > 0:
        merged = merged.repartition(partitions, F.slice("items", 1, mu))
    rho = max(1, rho)
    rows = merged.select(F.array().cast("array<int>").alias("items"), F.col("items").alias("path"), "w")
    out = None
    for _ in range(1, rho):
        rows = project(rows)
        counted = materialize(rows.groupBy("items").agg(F.sum("w").alias("support")).where(F.col("support") > count), "counted")
        out = counted if out is None else out.unionByName(counted)
        rows = _only(rows, counted.select("items"), counted.count())
    rows = materialize(project(rows).groupBy("items", "path").agg(F.sum("w").alias("w")), "paths")
    conditional = None
    while True:
        sizes = rows.groupBy("items").agg(F.count("*").alias("paths"), F.sum("w").alias("support"))
        large = materialize(sizes.where((F.col("paths") > GROUP_PATHS) & (F.col("support") > count)), "large")
        n_large = large.count()
        if not n_large:
            conditional = rows if conditional is None else conditional.unionByName(rows)
            break
        sets = F.broadcast(large.select("items")) if n_large <= BROADCAST_SETS else large.select("items")
        counted = large.select("items", "support")
        out = counted if out is None else out.unionByName(counted)
        rest = rows.join(sets, "items", "left_anti")
        conditional = rest if conditional is None else conditional.unionByName(rest)
        split = project(rows.join(sets, "items", "left_semi").select("items", "path", "w"))
        rows = materialize(split.groupBy("items", "path").agg(F.sum("w").alias("w")), "paths")

    def mine(group: pa.Table) -> pa.Table:
        items = group.column("items")[0].as_py()
        weights = group.column("w").to_pylist()
        sets = [(items, sum(weights))] if sum(weights) > count else []
        if sets:
            sets += [(items + list(more), w) for more, w in grow([(tuple(p), w) for p, w in zip(group.column("path").to_pylist(), weights, strict=True) if p], count)]
        return pa.table([pa.array([s for s, _ in sets], pa.list_(pa.int32())), pa.array([w for _, w in sets], pa.int64())], names=["items", "support"])

    mined = conditional.groupBy("items").applyInArrow(mine, SETS)
    out = mined if out is None else out.unionByName(mined)
    return out.select(F.array_sort("items").alias("items"), "support")


def in_order(sets: DataFrame) -> DataFrame:
    """By number of items, then item by item."""
    return sets.orderBy(F.size("items"), "items")
