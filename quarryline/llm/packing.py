"""Harmonic packing of documents into fixed-length token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths above
``capacity // (k + 1)`` up to ``capacity // k``, and each of its sequences is
filled with exactly k documents.  Of a document longer than the capacity whole
sequences are cut off first, and what is left is classed.  A sequence of k
documents has room left; rooms are filled by later documents, cut only where
no room holds them whole, as soon as all rooms together hold such a document.
Every worker fills the sequences of its own partition and needs nothing from
the others: there is no shuffle, and what is still open at the end of a
partition (fewer than k documents in each class) fills the rooms, then whole
sequences and, for the last few tokens, sequences whose length is a power of
two.  Padding is at most the rooms left by the last sequences of a partition,
fewer than two capacities of tokens.

Defined results: a null or empty text is one document of the separator id
alone; very long texts are encoded whole; documents with a null id are packed
and their pieces have a null id; repeated rows are packed as often as they
occur; equal lengths are packed in the order of the rows; further columns,
whatever their names, are ignored; an empty table gives no rows.  Sequence ids
are unique in one run and depend on how the input is partitioned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import ByteBpe
from .common import chunks, give_back, spread_table

CAPACITY = 1024
SEPARATOR_ID = 0
#: Sequence ids of a partition begin at its number times this.
IDS_PER_PARTITION = 1 << 40
#: Bytes of text that are encoded at once; the arrays take some 50 times as many.
ENCODED_AT_ONCE = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Fills the sequences of one partition; rows of ``SCHEMA`` (and ids) leave as soon as their place is known."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        #: Documents of sequences that are not full, by class.
        self.open: dict[int, list[tuple]] = {}
        #: (room, sequence, offset) of sequences with their k documents, ascending.
        self.rooms: list[tuple[int, int, int]] = []
        self.room = 0

    def _fill(self, doc: int | None, start: int, ids: np.ndarray, tokens: int, out: list[tuple]) -> int:
        """Cuts ids into the rooms: into the smallest that holds them, else the largest rooms first. How many found room."""
        done = 0
        while done < len(ids) and self.rooms:
            at = bisect_left(self.rooms, (len(ids) - done,))
            room, sequence, offset = self.rooms.pop(min(at, len(self.rooms) - 1))
            take = min(room, len(ids) - done)
            out.append((doc, start + done, ids[done : done + take], tokens, sequence, offset))
            if take < room:
                insort(self.rooms, (room - take, sequence, offset + take))
            done += take
        self.room -= done
        return done

    def add(self, doc_ids: list[int | None], ids: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Takes documents' ids, one after another; (doc_id, start, ids, doc_tokens, sequence_id, offset) of pieces that are placed."""
        out: list[tuple] = []
        c = self.capacity
        for doc, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            for start in range(0, n - c + 1, c):
                out.append((doc, start, ids[a + start : a + start + c], n, self.next_id, 0))
                self.next_id += 1
            rest = n % c
            if not rest:
                continue
            piece = ids[b - rest : b]
            if rest <= self.room:
                self._fill(doc, n - rest, piece, n, out)
                continue
            k = c // rest
            group = self.open.setdefault(k, [])
            group.append((doc, n - rest, piece, n))
            if len(group) == k:
                offset = 0
                for d, s, x, m in self.open.pop(k):
                    out.append((d, s, x, m, self.next_id, offset))
                    offset += len(x)
                if offset < c:
                    insort(self.rooms, (c - offset, self.next_id, offset))
                    self.room += c - offset
                self.next_id += 1
        # what waits must not hold the whole chunk
        self.open = {k: [(d, s, x.copy(), m) for d, s, x, m in group] for k, group in self.open.items()}
        return out

    def finish(self) -> list[tuple]:
        """Cuts what is open into the rooms, whole sequences, and sequences of a power of two."""
        pieces, out, left = [p for k in sorted(self.open) for p in self.open[k]], [], []
        self.open = {}
        for doc, start, ids, n in reversed(pieces):
            done = self._fill(doc, start, ids, n, out)
            if done < len(ids):
                left.append((doc, start + done, ids[done:], n))
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        used, room = 0, iter(sizes)
        size = next(room, 0)
        for doc, start, ids, n in left:
            done = 0
            while done < len(ids):
                if used == size:
                    size, used = next(room), 0
                    self.next_id += 1
                take = min(size - used, len(ids) - done)
                out.append((doc, start + done, ids[done : done + take], n, self.next_id, used))
                used, done = used + take, done + take
        self.next_id += bool(left)
        return out


def pack(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, separator: int = SEPARATOR_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece, ``SCHEMA`` (with ``ids array<long>`` if they are kept)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: its size does not follow the input
    columns = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True)) if pieces else [()] * 6
        doc, start, ids, n, seq, off = cols
        crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids]
        arrays = [pa.array(x, pa.int64()) for x in (doc, start, [len(x) for x in ids], crc, n, seq, off)]
        names = list(columns)
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe = ByteBpe(shared.value)
        packer = Packer(capacity, TaskContext.get().partitionId() * IDS_PER_PARTITION)
        for batch, data, at in chunks(batches, "text", ENCODED_AT_ONCE):
            ids, first = bpe.encode(data, at)
            ids = np.insert(ids, first[1:], separator)
            yield rows(packer.add(batch.column("doc_id").to_pylist(), ids, first + np.arange(len(first))))
        yield rows(packer.finish())
        del bpe, packer
        give_back()

    from pyspark.sql import functions as F

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA + (", ids array<long>" if keep_ids else ""))


def read_vocabulary(path: str | None = None) -> bytes:
    """A tokenizers JSON file; by default the public 50k byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread_table(spark, sf_dir, "documents"), read_vocabulary())
