"""Benchmark decontamination by suffix arrays of the training words.

Every chunk of documents (a shard of at most ``CHUNK_BYTES`` of text) gets the
suffix array of its words, and every suffix of every benchmark item is looked
up in it by binary search, all at once: suffixes with the same first ``window``
words (an item of fewer words: all of them) as one.  The range that is found
holds the locations where at least these words stand; ``matches`` extends each
to the longest verbatim match.  The union of the matches' words is the union of
their windows, so the words and items that are hit, and the documents that
``remove`` drops, come from the same ranges without the extension.

The documents are never shuffled.  Benchmark items are sent to the workers in
blocks of at most ``BLOCK_WORDS`` words, one after another; with more than one
block the documents are read once per block, each block's spans are written to
the shared folder, and the spans of hit documents are merged.

Defined results: a null text and a text without words have no words and are
clean; very long texts are a shard each; repeated rows are judged one by one; a
null item text, or one without words, occurs nowhere; items without an id are
searched like any other, count as one item, and are left out of the hashed
list; documents with a null id are judged like any other; item ids are compared
as strings; empty tables give no rows, or clean documents; further columns of
the inputs, whatever their names, are kept by ``remove`` and ignored by
``contamination``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks, slices, spans_to_index, spread_table, table, words
from .word_suffixes import Words, WordSuffixArray, extend

WINDOW = 10
#: Words of benchmark items that are sent to the workers at once.
BLOCK_WORDS = 2_000_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "row long, starts array<long>, ends array<long>, items array<string>"
MATCHES = "doc_id long, item_id string, item_word long, doc_word long, n_words long"


@dataclass
class Block:
    """Benchmark items: their vocabulary and words (0 ends an item), and the search patterns.

    A pattern is one sequence of words; it stands at ``begin[at[i]:at[i + 1]]`` of the words, in ``item``.
    """

    vocabulary: pa.Array
    tokens: np.ndarray
    length: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    ids: list[str | None]
    low: list[np.ndarray]
    high: list[np.ndarray]


def make_block(ids: list, texts: list[str | None], window: int) -> Block:
    data = [(t or "").encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64)
    low, starts, ends, first = words(np.frombuffer(b"".join(data), np.uint8), at)
    coded = slices(low, starts, ends).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False) + 1 if len(starts) else np.zeros(0, np.int64)
    tokens = np.insert(which.astype(np.int64), first[1:], 0)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(1, count - window + 1), 0)  # patterns of each item
    begin = spans_to_index(first[:-1] + np.arange(len(ids)), n)
    item = np.repeat(np.arange(len(ids)), n)
    length = np.repeat(np.minimum(count, window), n)
    every = Words(tokens, len(coded.dictionary))
    levels = -(-window // every.per_key)
    lows = [every.packed(begin, k, length) for k in range(levels)]
    order = np.lexsort([*lows[::-1], length])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (length, *lows)], axis=0)
    edge = np.flatnonzero(new)
    begin, item, length = begin[order], item[order], length[order]
    one = begin[edge]
    return Block(coded.dictionary, tokens, length[edge], np.append(edge, len(order)), begin, item, [None if x is None else str(x) for x in ids], [every.packed(one, k, length[edge]) for k in range(levels)], [every.packed(one, k, length[edge], True) for k in range(levels)])


def blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Block]]:
    """Number of blocks, and the blocks one after another: items with a text, dealt by a hash into as many blocks as their words need."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    # a word has at least one byte and one separator, so half the bytes bound the words
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // 2 // block_words) + 1

    def each() -> Iterator[Block]:
        for b in range(n):
            own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items
            rows = own.orderBy("item", "text").toArrow().to_pydict()  # at most about BLOCK_WORDS words
            yield make_block(rows["item"], rows["text"], window)

    return n, each()


class Shard:
    """A chunk of documents with the suffix array of its words, and the places where a block's patterns stand."""

    def __init__(self, block: Block, data: np.ndarray, at: np.ndarray):
        low, starts, ends, self.first = words(data, at)
        self.counts = np.diff(self.first)
        found = pc.index_in(slices(low, starts, ends), value_set=block.vocabulary) if len(block.vocabulary) else pa.nulls(len(starts), pa.int32())
        ids = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.tokens = np.insert(ids, self.first[1:], 0)  # 0 ends a text
        self.begin = self.first + np.arange(len(self.first))
        self.array = WordSuffixArray(self.tokens, len(block.vocabulary))
        lo, hi = self.array.ranges(block.low, block.high) if len(block.length) else (np.zeros(0, np.int64),) * 2
        hit = np.flatnonzero(hi > lo)
        n = hi[hit] - lo[hit]
        #: For each place where a pattern occurs: the pattern, the token, and the document.
        self.pattern = np.repeat(hit, n)
        self.place = self.array.suffixes[spans_to_index(lo[hit], n)]
        self.doc = np.searchsorted(self.begin, self.place, "right") - 1
        self.length = block.length[self.pattern]


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals, as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _by_document(shard: Shard, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str | None]]]:
    """Hit documents of a shard with their runs of hit words and the items found in them."""
    if not len(shard.doc):
        return
    order = np.argsort(shard.doc, kind="stable")
    docs, at = np.unique(shard.doc[order], return_index=True)
    for doc, own in zip(docs.tolist(), np.split(order, at[1:]), strict=True):
        begin = shard.place[own] - shard.begin[doc]
        s, e = _runs(begin, begin + shard.length[own])
        patterns = np.unique(shard.pattern[own])
        items = block.item[spans_to_index(block.at[patterns], block.at[patterns + 1] - block.at[patterns])]
        yield doc, s, e, {block.ids[i] for i in np.unique(items).tolist()}


def _sha(items: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``RESULT``: one row per document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_blocks, each = blocks(benchmark, window, item_col, item_text, block_words)
    if n_blocks == 1:
        shared = spark.sparkContext.broadcast(next(each))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, none = shared.value, _sha(set())
            for batch, data, at in chunks(batches):
                shard = Shard(block, data, at)
                n = batch.num_rows
                hit, items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
                for doc, s, e, ids in _by_document(shard, block):
                    hit[doc], items[doc], sha[doc] = (e - s).sum(), len(ids), _sha(ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard.counts, pa.int64()), pa.array(hit), pa.array(items), pa.array(sha, pa.string()), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return narrow.mapInArrow(run, RESULT)

    # rows get numbers that hold whenever they are read again
    rows = materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "rows")
    merged = None
    for block in each:
        shared = spark.sparkContext.broadcast(block)

        def spans(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch, data, at in chunks(batches):
                found = list(_by_document(Shard(block, data, at), block))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1].tolist() for x in found], longs), pa.array([x[2].tolist() for x in found], longs), pa.array([list(x[3]) for x in found], pa.list_(pa.string()))], ["row", "starts", "ends", "items"])

        part = materialize(rows.mapInArrow(spans, SPANS), "spans")
        shared.destroy()
        merged = part if merged is None else merged.union(part)
    merged = merged.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans_col = F.array_sort(F.arrays_zip("starts", "ends"))
    covered = F.aggregate(spans_col, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), lambda a, x: F.struct((a["n"] + F.greatest(x["ends"] - F.greatest(x["starts"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["ends"]).alias("upto")))
    hits = merged.select("row", covered["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    return rows.mapInArrow(_count_words, "row long, doc_id long, n_words long").join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_sha(set()))).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(words(data, at)[3]), pa.int64())], ["row", "doc_id", "n_words"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``MATCHES``: longest verbatim matches of at least ``window`` words (or of a whole item) with their word positions; a match that continues one of the word before is not told again."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    n_blocks, each = blocks(benchmark, window, item_col, item_text, block_words)
    for block in each:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch, data, at in chunks(batches):
                shard = Shard(block, data, at)
                n = block.at[shard.pattern + 1] - block.at[shard.pattern]
                of = spans_to_index(block.at[shard.pattern], n)  # every place with every suffix that begins with its pattern
                begin, item, place, doc = block.begin[of], block.item[of], np.repeat(shard.place, n), np.repeat(shard.doc, n)
                before = (begin > 0) & (place > 0)
                before[before] = (block.tokens[begin[before] - 1] == shard.tokens[place[before] - 1]) & (block.tokens[begin[before] - 1] != 0)
                begin, item, place, doc = begin[~before], item[~before], place[~before], doc[~before]
                length = extend(shard.tokens, place, block.tokens, begin)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array([block.ids[i] for i in item.tolist()], pa.string()), pa.array(begin - begin_of(block)[item]), pa.array(place - shard.begin[doc]), pa.array(length)], ["doc_id", "item_id", "item_word", "doc_word", "n_words"])

        part = narrow.mapInArrow(run, MATCHES)
        if n_blocks > 1:
            part = materialize(part, "matches")
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def begin_of(block: Block) -> np.ndarray:
    """Where each item's words begin in ``block.tokens``."""
    ends = np.flatnonzero(block.tokens == 0)
    return np.append(0, ends[:-1] + 1) if len(ends) else np.zeros(0, np.int64)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, in which no item occurs."""
    spark = docs.sparkSession
    out = docs
    n_blocks, each = blocks(benchmark, window, block_words=block_words)
    for block in each:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, at in chunks(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                clean[Shard(shared.value, data, at).doc] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
        if n_blocks > 1:
            out = materialize(out, "clean")
            shared.destroy()
    return out


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
