"""Near-duplicates by SimHash fingerprints and Golay-code keys.

Fingerprints are computed in one pass (a call of the hash library per shingle;
majorities are array operations).  Documents with the same fingerprint are one
class, named by its smallest id; only classes are compared.  Each class gets
about 29 keys (see ``golay``); classes that share a key are sorted next to each
other and verified by the number of differing bits.  Within a key only links
that join two groups are told, so a key shared by k classes yields at most
k - 1 links, verified pairs already joined are skipped, and a key is done as
soon as its classes are one group.  Keys with more than ``LONG_KEY`` classes
are not compared at once: each of their classes gets further keys from the
third segment (see ``golay.further_keys``), by which they are shuffled again,
so no task holds such a key.  Components of the links then name each group.

Defined results: null and empty texts, and texts of separators, have
fingerprint 0 and are linked like any other; texts of fewer words than a
shingle have one shingle of all their words; very long texts are hashed whole;
documents with a null id belong to the group of their fingerprint but never
name it (a group of such documents alone has a null component); repeated rows
repeat, and are ties that share a class; an empty table gives no rows; further
columns are ignored by ``simhash_groups`` and kept by ``keep_one``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import materialize
from .common import chunks, fresh, spread_table
from .golay import further_keys, keys

SHINGLE, SEED, BITS = 4, 42, 4
#: Rows of whole key groups that are compared at once.
ROWS_AT_ONCE = 1 << 18
#: Fingerprints of one key that are compared pair by pair; more are dealt out by further keys.
LONG_KEY = 1 << 14
#: Ids that are sent to every executor at once, at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

GROUPS = "doc_id long, fingerprint string, component_id long"


def fingerprint_texts(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: majority bits of XXH64 over all word shingles."""
    whole = data.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        split = whole[a:b].lower().split()
        n = len(split)
        if not n:
            continue
        joined = b" ".join(split)
        if n <= shingle:
            hashes.append(digest(joined, seed))
            counts[i] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        hashes += [digest(joined[s:e], seed) for s, e in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        counts[i] = n - shingle + 1
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.array(hashes, np.uint64)
        first = (np.cumsum(counts) - counts)[full]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int64), first)
            out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprint_texts(data, at).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def join_groups(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: links between rows of a key that differ in at most ``bits`` bits, as few as join what belongs together."""
    n = len(key)
    parent = np.arange(n)
    root = np.arange(n)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    left, right = [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    active, shift = np.arange(n - 1), 1
    while len(active):
        active = active[active + shift < n]
        active = active[key[active] == key[active + shift]]
        if not len(active):
            break
        apart = active[root[active] != root[active + shift]]
        close = apart[popcount(fp[apart] ^ fp[apart + shift]) <= bits]
        joined = False
        for i in close.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + shift)
                joined = True
        if joined:
            root = parent.copy()
            while not np.array_equal(further := root[root], root):
                root = further
            parent[:] = root
            if shift & (shift - 1) == 0 or shift % 64 == 0:  # keys that are one group are done
                whole = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
                active = active[~np.repeat(whole, size)[active]]
        shift += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(bits: int, longest: int | None = None):
    """Streams rows sorted by key: (src, dst, false) are links. Whole key groups are compared, the last one waits for the next batch; those of more than ``longest`` rows are told as (key, fp, true) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, passed = 0, None

        def told(a: np.ndarray, b: np.ndarray, is_long: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), is_long))], ["src", "dst", "long"])

        def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if longest is not None:
                first = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
                size = np.diff(np.append(first, rows.shape[1]))
                over = np.repeat(size > longest, size)
                if over.any():
                    yield told(rows[0][over], rows[1][over], True)
                    rows = rows[:, ~over]
            if rows.shape[1]:
                a, b = join_groups(rows[0], rows[1].view(np.uint64), bits)
                yield told(rows[1][a], rows[1][b], False)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp")])
            if passed is not None:  # a key that was found to be long goes on
                n = int(np.searchsorted(new[0], passed, "right"))
                if n:
                    yield told(new[0][:n], new[1][:n], True)
                    new = new[:, n:]
                if not new.shape[1]:
                    continue
                passed = None
            held.append(new)
            waiting += new.shape[1]
            if waiting >= ROWS_AT_ONCE:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield from compare(rows[:, :cut])
                rest = rows[:, cut:]
                if longest is not None and rest.shape[1] > longest:
                    yield told(rest[0], rest[1], True)
                    passed, held, waiting = rest[0][0], [], 0
                else:
                    held, waiting = [rest], rest.shape[1]
        if waiting:
            yield from compare(np.concatenate(held, axis=1))

    return run


def classes(known: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, link, component_id: for each fingerprint its group's smallest linked fingerprint, and the smallest id reachable by links of at most ``bits`` bits. ``known``: doc_id and fp."""
    if bits > BITS:
        raise ValueError(f"keys find links of at most {BITS} bits, not {bits}")
    spark = known.sparkSession
    nodes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            key, of = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[of])], ["key", "fp"])

    def send_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("dst").to_numpy(zero_copy_only=False).astype(np.int64)
            key, of = further_keys(fp.view(np.uint64), batch.column("src").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[of])], ["key", "fp"])

    n, told = int(spark.conf.get("spark.sql.shuffle.partitions")), "src long, dst long, long boolean"
    sent = nodes.select("fp").mapInArrow(send, "key int, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    links = materialize(sent.mapInArrow(_links(bits, LONG_KEY), told), "links")
    over = links.where("long").count()
    if over:
        more = links.where("long").select("src", "dst").mapInArrow(send_further, "key long, fp long").repartition(max(n, over // 20_000), "key").sortWithinPartitions("key", "fp")
        links = materialize(links.where("NOT long").union(more.mapInArrow(_links(bits), told)), "links")
    links = links.select("src", "dst")
    found = materialize(connected_components(links).withColumnRenamed("id", "fp").join(nodes, "fp"), "linked")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    group = found.join(least, "component").select("fp", "component", "least")
    return nodes.join(group, "fp", "left").select("fp", F.coalesce("component", "fp").alias("link"), F.coalesce("least", "node").alias("component_id"))


def simhash_groups(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``GROUPS``: each document's fingerprint and the smallest id of its group."""
    known = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = classes(known, bits)
    return known.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spread_table(spark, sf_dir, "documents"))


def _send_few(ids: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` ids as a join's side: broadcast if it is small, else shuffled."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: one with the id that names the group.

    Groups in which no row has an id keep one row.  An id on several rows does
    not tell them apart: their texts are fingerprinted again, so each group
    keeps one row of its own, and rows of other groups stay.  Only ids and
    fingerprints are compared; texts move only where an id stands on several
    rows or is null, or where more than ``BROADCAST_IDS`` documents go.
    """
    idc, fpc = fresh(docs.columns, "id", "fp")
    known = materialize(fingerprints(docs, id_col, text_col).select(F.col("doc_id").alias(idc), F.col("fp").alias(fpc)), "fingerprints")
    named = classes(known.select(F.col(idc).alias("doc_id"), F.col(fpc).alias("fp")), bits).select(F.col("fp").alias(fpc), "link")
    # nulls sort last, so a group is named by its smallest id if it has any
    least = F.min(F.struct(F.col(idc).isNull().alias("none"), F.col(idc), F.col(fpc)))
    chosen = materialize(known.join(named, fpc).groupBy("link").agg(least.alias("c")).select(f"c.{idc}", f"c.{fpc}"), "chosen")
    rows = materialize(known.where(F.col(idc).isNotNull()).groupBy(idc).agg(F.count("*").alias("n"), F.min(fpc).alias(fpc)), "rows")
    several = rows.where("n > 1").select(idc)
    lost = rows.where("n = 1").join(chosen, [idc, fpc], "left_anti").select(idc)
    away = materialize(lost.union(several), "away")
    keyed = docs.withColumn(idc, F.col(id_col).cast("long"))
    kept = keyed.where(F.col(idc).isNotNull()).join(_send_few(away, away.count()), idc, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    n_several, n_null = several.count(), known.where(F.col(idc).isNull()).limit(1).count()
    if not n_several and not n_null:
        return kept
    doubtful = keyed.where(F.col(idc).isNull())
    if n_several:
        doubtful = doubtful.unionByName(keyed.join(_send_few(several, n_several), idc, "left_semi").select(*(F.col(f"`{c}`") for c in keyed.columns)))
    marked = doubtful.mapInArrow(_with_fingerprint(text_col, fpc), T.StructType([*keyed.schema.fields, T.StructField(fpc, T.LongType())]))
    same = marked[fpc].eqNullSafe(chosen[fpc]) & marked[idc].eqNullSafe(chosen[idc])
    one = marked.join(chosen, same, "left_semi").dropDuplicates([idc, fpc])
    return kept.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def _with_fingerprint(text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprint_texts(data, at).view(np.int64))], [*batch.schema.names, name])

    return run
