"""Exact repeats across documents by blockwise suffix sorting.

A byte goes if a ``width``-byte string that covers it also starts in a
document with a smaller id.  Documents are packed into blocks, and every
string of ``width`` bytes gets an anchor: its ``SEED``-byte part with the
smallest hash.  Equal strings have equal anchors, and strings that follow one
another mostly share theirs, so a text falls into pieces with one anchor each.

1. Blocks send their distinct anchors (6 bytes each, delta-coded) to buckets,
   which tell each block the anchors that occur in another document.
2. Blocks send the pieces with such anchors, identical pieces once, to buckets
   by anchor.  A bucket merges identical pieces (the smallest id of their
   documents is all that counts of them), sorts the suffixes of those whose
   anchor has several pieces (see ``suffixes``), finds runs that agree over
   ``width`` bytes, and answers with one bit per string: whether a document
   with a smaller id has it.
3. Blocks put the bits together and remove the covered bytes.

A passage with very many different contexts gives its anchor a piece for each
context.  Buckets with more than ``HOT_BYTES`` of pieces are therefore cut once
more: their strings travel one by one to buckets by a hash of the whole string,
are suffix-sorted there in the same way, and their bits are put together by
block.  What a bucket holds then follows the number of blocks that one string
stands in (a string is sent once per block), not the number of its contexts.

Each block sends a row to nearly every bucket, so the rows grow with the square
of the texts.  Beyond ``MANY_BUCKETS`` buckets therefore become larger, up to
``CELLS`` times; a bucket of pieces then has cells, by anchor, which are sorted
one after another, and it is cells that are cut if they are too large.

Only anchors, shared pieces and bits travel: blocks lie in buckets of their
number and are joined with what they are sent where they are.  The numbers of
all buckets follow the bytes of the texts.  All tables between the steps lie in
the shared folder.

Defined results: null and empty texts have no bytes; texts shorter than
``width`` stay; rows with the same id never remove each other's bytes, so
repeated rows keep what one of them keeps; a null id counts as larger than all
others; ties cannot occur, since only the smallest id matters; an empty table
gives no rows; very long texts are a block each, so a single document must fit
into a worker's memory; ``remove_repeats`` keeps further columns of any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, materialize_by, release
from .common import byte_view, chunks, slices, spans_to_index, spread_table
from .suffixes import SuffixSorter

WIDTH, SEED = 50, 16
BLOCK_BYTES = 4 << 20
#: Bytes of texts that are cut into pieces at once.
PIECES_AT_ONCE = 1 << 20
#: Mean bytes of anchors, and of texts whose pieces meet, for each bucket.
ANCHOR_BUCKET, PIECE_BUCKET = 4 << 20, 4 << 20
#: Bytes of texts whose blocks one task reads, about.
BLOCKS_BUCKET = 32 << 20
#: More buckets than these are made only of buckets that are ``CELLS`` times as large.
MANY_BUCKETS, CELLS = 256, 4
#: Bytes of pieces beyond which a cell of a bucket is cut into strings.
HOT_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).max

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

BLOCKS = "block long, bytes long, payload binary"
ANCHORS = "bucket int, block long, anchors binary"
TRAFFIC = "kind int, block long, bucket int, sizes array<long>, data binary, more binary"
STRINGS = "sub int, block long, bucket int, data binary, more binary"
MARKS = "block long, bucket int, data binary"
PIECES, PLACES, BITS = 0, 1, 2


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _squeeze(x: bytes | np.ndarray, level: int = 1) -> bytes:
    return _compressor(level).compress(x)


def _swell(x: bytes) -> bytes:
    return _decompressor().decompress(x)


def _planes(x: np.ndarray) -> bytes:
    """Non-negative integers: their width, then bytes of equal weight next to each other."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(x: bytes) -> np.ndarray:
    width = x[0]
    planes = np.frombuffer(x, np.uint8, offset=1) if len(x) > 1 else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)


def pack_numbers(x: np.ndarray) -> bytes:
    return _squeeze(_planes(x))


def unpack_numbers(x: bytes) -> np.ndarray:
    return _numbers(_swell(x))


def _pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=0))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(x))


def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return _squeeze(sink.getvalue().to_pybytes(), 3)


def _from_ipc(x: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(_swell(x)) as r:
        return r.read_next_batch()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    return x ^ (x >> np.uint64(31))


def pieces(data: np.ndarray, at: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into pieces: anchors (48 bits), first strings, numbers of strings, and documents. A few texts are looked at at once, as the arrays take many times their bytes."""
    out, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECES_AT_ONCE, "right")) - 1)
        anchor, start, count, doc = _pieces(data[at[first] : at[last]], at[first : last + 1] - at[first], width, seed)
        out.append((anchor, start + at[first], count, doc + first))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _pieces(data: np.ndarray, at: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < width:
        return none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,)).astype(np.uint64)
    n = len(data) - seed + 1
    h = _mix(word[:n] ^ _B)
    for k in [*range(8, seed - 7, 8), seed - 8][: (seed - 1) // 8]:
        h = _mix(h ^ (word[k : k + n] * _C))
    reach, size = width - seed + 1, 1  # smallest hash of ``reach`` neighbours
    while 2 * size <= reach:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < reach:
        rest = reach - size
        h = np.minimum(h[:-rest], h[rest:])
    # strings that end within their text
    length = np.maximum(np.diff(at) - width + 1, 0)
    where = spans_to_index(at[:-1], length)
    if not len(where):
        return none
    h, doc = h[where], np.repeat(np.arange(len(length)), length)
    new = np.ones(len(where), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return (h[first] >> np.uint64(16)).astype(np.int64), where[first], np.diff(np.append(first, len(where))), doc[first]


def _ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    return pc.fill_null(batch.column(id_col).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _text(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    return byte_view(batch.column(text_col))


def _send_anchors(id_col: str, text_col: str, width: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, payload in zip(rows.column("block").to_pylist(), rows.column("payload"), strict=True):
                batch = _from_ipc(payload.as_py())
                ids = _ids(batch, id_col)
                anchor, _, _, doc = pieces(*_text(batch, text_col), width)
                if not len(anchor):
                    continue
                # an anchor of two documents of the block is shared already
                order = np.argsort(anchor, kind="stable")
                anchor, owner = anchor[order], ids[doc[order]]
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                anchor = anchor[first]
                bucket = anchor % n_buckets
                code = anchor // n_buckets * 2 + several
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(edge[1:] > edge[:-1])
                blobs = [_pack_sorted(code[order[edge[b] : edge[b + 1]]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "anchors"])

    return run


def _meet_anchors(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each block its anchors that another document has."""
    codes = [_unpack_sorted(x.as_py()) for x in rows.column("anchors")]
    every = np.concatenate(codes)
    value = every >> 1
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(first, len(ordered)))
    shared = (count > 1) | (np.maximum.reduceat(every[order] & 1, first) > 0)
    mask = np.empty(len(every), bool)
    mask[order] = np.repeat(shared, count)
    at, out, keep = 0, [], []
    for i, c in enumerate(codes):
        own = (c >> 1)[mask[at : at + len(c)]]
        at += len(c)
        if len(own):
            keep.append(i)
            out.append(_pack_sorted(own))
    rows = rows.take(pa.array(keep, pa.int64()))
    return pa.table([rows.column("bucket"), rows.column("block"), pa.array(out, pa.binary())], names=["bucket", "block", "anchors"])


Emit = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]
"""(rows, bytes, offsets, removed) -> result rows; ``removed`` marks bytes."""


def _traffic(kind: int, block: list[int], data: list[bytes], buckets: list[int] | None = None, sizes: list[list[int]] | None = None, more: list[bytes] | None = None) -> pa.Table:
    n = len(data)
    return pa.table([pa.array([kind] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(buckets or [None] * n, pa.int32()), pa.array(sizes or [None] * n, pa.list_(pa.int64())), pa.array(data, pa.binary()), pa.array(more or [None] * n, pa.binary())], names=["kind", "block", "bucket", "sizes", "data", "more"])


def _join_fields(parts: list[np.ndarray]) -> bytes:
    x = _squeeze(b"".join(len(p).to_bytes(8, "little") + p for p in map(_planes, parts)))
    return len(x).to_bytes(8, "little") + x


def _send_pieces(id_col: str, text_col: str, width: int, anchor_buckets: int, piece_buckets: int, cells: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """The distinct pieces of a block with shared anchors, by bucket (PIECES), and where they stand in the block (PLACES). A bucket's pieces lie in the order of its cells; ``sizes`` holds the bytes of each cell."""
        if not blocks.num_rows or not answers.num_rows:
            return _traffic(PIECES, [], [])
        block = blocks.column("block")[0].as_py()
        batch = _from_ipc(blocks.column("payload")[0].as_py())
        data, at = _text(batch, text_col)
        ids = _ids(batch, id_col)
        anchor, start, count, doc = pieces(data, at, width)
        shared = np.concatenate([_unpack_sorted(x.as_py()) * anchor_buckets + b for b, x in zip(answers.column("bucket").to_pylist(), answers.column("anchors"), strict=True)])
        hit = np.isin(anchor, shared)
        anchor, start, count, doc = anchor[hit], start[hit], count[hit], doc[hit]
        coded = slices(data, start, start + count + width - 1).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        size = len(coded.dictionary)
        owner = np.full(size, NO_ID)
        np.minimum.at(owner, code, ids[doc])
        code_anchor = np.zeros(size, np.int64)
        code_anchor[code] = anchor
        cell = code_anchor % piece_buckets * cells + code_anchor // piece_buckets % cells
        order = np.argsort(cell, kind="stable")
        per_cell = np.bincount(cell, minlength=piece_buckets * cells).reshape(-1, cells)
        in_bucket = per_cell.sum(axis=1)
        edge = np.append(0, np.cumsum(in_bucket))
        full = np.flatnonzero(in_bucket)
        # all pieces in the order of the buckets, of which each payload is a slice
        data, at = byte_view(coded.dictionary.take(pa.array(order)))
        length, owned, anchored = np.diff(at), owner[order], code_anchor[order]
        upto = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(per_cell.reshape(-1)))]
        sizes = np.diff(upto).reshape(-1, cells)[full].tolist()
        payloads, more = [], []
        for bucket in full.tolist():
            a, b = edge[bucket], edge[bucket + 1]
            low = int(owned[a:b].min())
            payloads.append(_squeeze(data[at[a] : at[b]], 3))
            more.append(_join_fields([length[a:b], owned[a:b] - low, anchored[a:b], per_cell[bucket]]) + low.to_bytes(8, "little"))
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        late = (ids[doc] != owner[code]).astype(np.int64)
        places = _join_fields([np.diff(start, prepend=0), count, place[code] * 2 + late, in_bucket[full]])
        return pa.concat_tables([_traffic(PIECES, [block] * len(full), payloads, full.tolist(), sizes, more), _traffic(PLACES, [block], [places])])

    return run


def _fields(blob: bytes, count: int) -> tuple[list[np.ndarray], bytes]:
    """Packed numbers, each after its length, and what follows them."""
    end = 8 + int.from_bytes(blob[:8], "little")
    raw = _swell(blob[8:end])
    out, at = [], 0
    for _ in range(count):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(_numbers(raw[at + 8 : at + 8 + n]))
        at += 8 + n
    return out, blob[end:]


def _sort_pieces(width: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one bucket: for each block one bit for each string of its pieces, in order; cells in ``skip`` are settled elsewhere and have zeros."""
        texts, lengths, owners, anchors, cells = [], [], [], [], []
        for payload, more in zip(rows.column("data"), rows.column("more"), strict=True):
            (length, owner, anchor, per_cell), low = _fields(more.as_py(), 4)
            texts.append(_swell(payload.as_py()))
            lengths.append(length)
            owners.append(owner + int.from_bytes(low, "little"))
            anchors.append(anchor)
            cells.append(np.repeat(np.arange(len(per_cell)), per_cell))
        skip = rows.column("skip")[0].as_py() or ()
        length, owner, anchor, cell = (np.concatenate(x) for x in (lengths, owners, anchors, cells))
        at = np.append(0, np.cumsum(length))
        text = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(b"".join(texts))])
        del texts
        count = length - width + 1
        begin = np.append(0, np.cumsum(count))
        marks = np.zeros(begin[-1], bool)
        for c in np.unique(cell).tolist():
            if c in skip:
                continue
            own = np.flatnonzero(cell == c)
            whole = len(own) == len(length)
            for first, last, late in _late_strings(text if whole else text.take(pa.array(own)), owner[own], anchor[own], width):
                marks[slice(begin[first], begin[last]) if whole else spans_to_index(begin[own[first:last]], count[own[first:last]])] = late
        edge = begin[np.append(0, np.cumsum([len(x) for x in lengths]))].tolist()
        answer = [_squeeze(np.packbits(marks[a:b])) for a, b in zip(edge, edge[1:], strict=False)]
        return _traffic(BITS, rows.column("block").to_pylist(), answer, rows.column("bucket").to_pylist())

    return run


def _late_strings(text: pa.LargeBinaryArray, owner: np.ndarray, anchor: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of pieces, and for each string of these whether a document with a smaller id than the piece's has it."""
    coded = text.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    n = len(coded.dictionary)
    least = np.full(n, NO_ID)
    np.minimum.at(least, code, owner)
    of = np.zeros(n, np.int64)
    of[code] = anchor
    count = np.diff(byte_view(coded.dictionary)[1]) - width + 1
    begin = np.cumsum(count) - count
    smallest = np.repeat(least, count)  # of each string of each distinct piece
    # an anchor with a single distinct piece has nothing to sort
    which = np.unique(of, return_inverse=True)[1]
    own = np.flatnonzero(np.bincount(which)[which] > 1)
    if len(own):
        data, at = byte_view(coded.dictionary.take(pa.array(own)))
        slot = spans_to_index(begin[own], count[own])
        smallest[slot] = least_of_equal(data, spans_to_index(at[:-1], count[own]), smallest[slot], width)
    for first, last in _parts(count[code], PIECES_AT_ONCE):
        c = code[first:last]
        yield first, last, smallest[spans_to_index(begin[c], count[c])] < np.repeat(owner[first:last], count[c])


def least_of_equal(data: np.ndarray, starts: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """For each string data[starts[i]:starts[i] + width] the least value among all strings equal to it, by sorting the suffixes bucket by bucket."""
    sorter = SuffixSorter(data)
    index = np.full(len(data) + 1, -1, np.int64)
    index[starts] = np.arange(len(starts))
    out = values.copy()
    for bucket in sorter.buckets(starts):
        if len(bucket) > 1:
            alike = np.append(False, sorter.same(bucket[:-1], bucket[1:], width))
            first = np.flatnonzero(~alike)
            own = index[bucket]
            out[own] = np.repeat(np.minimum.reduceat(values[own], first), np.diff(np.append(first, len(bucket))))
    return out


def _cut_strings(width: int, n_sub: int):
    """The pieces of hot cells (``skip``) as single strings, by a hash of the string; ``more`` holds places among the payload's strings and owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in STRINGS.split(", ")]
        for batch in batches:
            for block, bucket, skip, payload, more in zip(*(batch.column(x).to_pylist() for x in ("block", "bucket", "skip")), batch.column("data"), batch.column("more"), strict=True):
                (length, owner, _, per_cell), low = _fields(more.as_py(), 4)
                data = np.frombuffer(_swell(payload.as_py()), np.uint8)
                hot = np.flatnonzero(np.isin(np.repeat(np.arange(len(per_cell)), per_cell), skip))
                count = length - width + 1
                piece_at, string_at = np.cumsum(length) - length, np.cumsum(count) - count
                # some pieces at once, as single strings take many times their bytes
                for first, last in _parts(count[hot], PIECES_AT_ONCE // width):
                    these = hot[first:last]
                    starts = spans_to_index(piece_at[these], count[these])
                    place = spans_to_index(string_at[these], count[these])
                    whose = np.repeat(owner[these], count[these])
                    sub = (_string_hash(data, starts, width) % np.uint64(n_sub)).astype(np.int64)
                    order = np.argsort(sub, kind="stable")
                    edge = np.flatnonzero(np.append(True, np.diff(sub[order]) != 0))
                    rows = []
                    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
                        own = order[a:b]
                        text = data[spans_to_index(starts[own], np.full(len(own), width))]
                        rows.append((int(sub[own[0]]), block, bucket, _squeeze(text.tobytes()), _join_fields([np.diff(place[own], prepend=0), whose[own]]) + low))
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    return run


def _parts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``limit``, or of one item."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + limit, "right")) - 1)
        yield first, last
        first = last


def _string_hash(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))
    h = np.zeros(len(starts), np.uint64)
    if width < 8:
        for k in range(width):
            h = _mix(h ^ (data[starts + k].astype(np.uint64) * _C))
        return h
    for k in [*range(0, width - 7, 8), width - 8]:
        h = _mix(h ^ (word[starts + k] * _C))
    return _mix(h)


def _settle_strings(width: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one bucket of single strings: the places, for each block and bucket that sent some, of those that a document with a smaller id has."""
        texts, owners, places, sizes = [], [], [], []
        for payload, more in zip(rows.column("data"), rows.column("more"), strict=True):
            (place, owner), low = _fields(more.as_py(), 2)
            texts.append(_swell(payload.as_py()))
            owners.append(owner + int.from_bytes(low, "little"))
            places.append(np.cumsum(place))
            sizes.append(len(place))
        owner = np.concatenate(owners)
        data = np.frombuffer(b"".join(texts), np.uint8)
        late = least_of_equal(data, np.arange(len(owner)) * width, owner, width) < owner
        out, at = [], 0
        for place, n in zip(places, sizes, strict=True):
            out.append(_pack_sorted(place[late[at : at + n]]))
            at += n
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return run


def _join_marks(rows: pa.Table) -> pa.Table:
    """Of one block and bucket: the bits of its strings from the places that are marked, up to the last of these."""
    marked = np.concatenate([_unpack_sorted(x.as_py()) for x in rows.column("data")])
    bits = np.zeros(marked.max(initial=0) + 1, np.uint8)
    bits[marked] = 1
    return _traffic(BITS, [rows.column("block")[0].as_py()], [_squeeze(np.packbits(bits).tobytes())], [rows.column("bucket")[0].as_py()])


def _finish(text_col: str, width: int, emit: Emit, names: list[str]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            raise RuntimeError("answers for a block that is not there")
        batch = _from_ipc(blocks.column("payload")[0].as_py())
        data, at = _text(batch, text_col)
        removed = np.zeros(len(data), bool)
        kind = answers.column("kind").to_numpy()
        own = np.flatnonzero(kind == PLACES)
        if len(own):
            (start, count, place, in_bucket), _ = _fields(answers.column("data")[int(own[0])].as_py(), 4)
            start, late, place = np.cumsum(start), place % 2 == 1, place // 2
            # strings of each distinct piece, in the order of the answers
            strings = np.zeros(int(in_bucket.sum()), np.int64)
            strings[place] = count
            begin = np.cumsum(strings) - strings
            bits = np.zeros(int(strings.sum()), bool)
            told = answers.filter(pa.array(kind == BITS))
            first_piece = np.cumsum(in_bucket) - in_bucket
            string_edge = np.append(begin[first_piece], len(bits))
            # the cells of a bucket may be answered apart
            for i, blob in zip(np.unique(told.column("bucket").to_numpy(), return_inverse=True)[1].tolist(), told.column("data"), strict=True):
                a, b = string_edge[i], string_edge[i + 1]
                bits[a:b] |= np.unpackbits(np.frombuffer(_swell(blob.as_py()), np.uint8), count=b - a).astype(bool)
            where = spans_to_index(start, count)
            where = where[bits[spans_to_index(begin[place], count)] | np.repeat(late, count)]
            depth = np.zeros(len(data) + 1, np.int32)
            depth[where] = 1  # every string stands in one piece
            np.subtract.at(depth, where + width, 1)
            removed = np.cumsum(depth[:-1], dtype=np.int32) > 0
        return pa.Table.from_batches([emit(batch, data, at, removed)]).select(names)

    return run


def bucket_numbers(total: int, size: int, least: int) -> tuple[int, int]:
    """How many buckets ``total`` bytes go to, and how many cells of about ``size`` bytes each bucket has."""
    n = -(-total // size)
    buckets = max(least, min(n, MANY_BUCKETS), -(-n // CELLS))
    return buckets, max(1, -(-n // buckets))


def process(docs: DataFrame, emit: Emit, schema: T.StructType | str, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Rows that ``emit`` makes of each block's documents and their removed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for i, (batch, data, _) in enumerate(chunks(batches, text_col, block_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([part + i], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([_to_ipc(batch)], pa.binary())], ["block", "bytes", "payload"])

    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(shuffle, -(-total // BLOCKS_BUCKET))
    anchor_buckets, _ = bucket_numbers(-(-total * 45 // 100), ANCHOR_BUCKET, 16)
    piece_buckets, cells = bucket_numbers(total, PIECE_BUCKET, 32)
    spread = lambda df, n, key: df.repartition(n, key) if n > shuffle else df
    blocks = materialize_by(docs.mapInArrow(pack, BLOCKS), "block", "blocks", n_blocks).select("block", "payload")
    sent = spread(blocks.mapInArrow(_send_anchors(id_col, text_col, width, anchor_buckets), ANCHORS), anchor_buckets, "bucket")
    shared = materialize(sent.groupBy("bucket").applyInArrow(_meet_anchors, ANCHORS), "shared")
    del sent
    traffic = materialize(blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_pieces(id_col, text_col, width, anchor_buckets, piece_buckets, cells), TRAFFIC), "pieces")
    del shared
    release(spark)
    sent = traffic.where(F.col("kind") == PIECES)
    sizes = sent.select("bucket", F.posexplode("sizes").alias("cell", "n")).groupBy("bucket", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot_bytes)
    hot = materialize(sizes, "hot")  # at most total / hot_bytes numbers
    n_hot = hot.agg(F.sum("n").alias("n")).first()["n"] or 0
    answers = traffic.where(F.col("kind") == PLACES)
    pieces_sent = [x.split(" ")[0] for x in TRAFFIC.split(", ")]
    if n_hot:
        known = F.broadcast(hot.groupBy("bucket").agg(F.collect_list("cell").alias("skip")))  # up to CELLS numbers
        sent = sent.join(known, "bucket", "left").select(*pieces_sent, "skip")
        n_sub = max(shuffle, -(-n_hot * width // 4 // PIECE_BUCKET))  # a piece has about four times its bytes / width strings at most
        strings = sent.where("skip IS NOT NULL").mapInArrow(_cut_strings(width, n_sub), STRINGS)
        marks = materialize(spread(strings, n_sub, "sub").groupBy("sub").applyInArrow(_settle_strings(width), MARKS), "marks")
        answers = answers.union(marks.groupBy("block", "bucket").applyInArrow(_join_marks, TRAFFIC))
        sent = sent.where(f"skip IS NULL OR size(skip) < {cells}")
    else:
        sent = sent.select(*pieces_sent, F.lit(None).cast("array<int>").alias("skip"))
    bits = spread(sent, piece_buckets, "bucket").groupBy("bucket").applyInArrow(_sort_pieces(width), TRAFFIC)
    answers = answers.union(bits)
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(text_col, width, emit, names), schema)


def runs(removed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes: documents, starts and ends within the documents."""
    if not removed.any():
        return (np.zeros(0, np.int64),) * 3
    border = np.zeros(len(removed) + 1, bool)
    border[at] = True
    first = removed & (np.append(True, ~removed[:-1]) | border[:-1])
    last = removed & (np.append(~removed[1:], True) | border[1:])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, a, "right") - 1
    return doc, a - at[doc], b - at[doc]


SUMMARY = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, starts array<long>, ends array<long>"


def repeat_summary(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SUMMARY``: what is removed from each document, and a digest of what is left."""

    def emit(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
        doc, _, _ = runs(removed, at)
        gone = np.concatenate([[0], np.cumsum(removed)])
        kept = data[~removed].tobytes()
        cut = at - gone[at]
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(gone[at])), pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64)), pa.array(sha, pa.string())], [x.split(" ")[0] for x in SUMMARY.split(", ")])

    return process(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), emit, SUMMARY, width)


def repeat_spans(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SPANS``: removed runs of each document, in bytes."""

    def emit(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
        doc, a, b = runs(removed, at)
        cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(cut, pa.array(a, pa.int64())), pa.ListArray.from_arrays(cut, pa.array(b, pa.int64()))], ["doc_id", "starts", "ends"])

    return process(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), emit, SPANS, width)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents, with all their columns and what is left of their texts.

    A character goes only if all its bytes go, so texts stay valid.  ``n_chars``
    names a column that counts characters and is set anew where a text changed.
    """

    def emit(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            whole = np.minimum.reduceat(removed, lead)
            removed = np.repeat(whole, np.diff(np.append(lead, len(data))))
        gone = np.concatenate([[0], np.cumsum(removed)])
        cut = at - gone[at]
        kept = data[~removed].tobytes()
        old = batch.column(text_col)
        changed = np.diff(gone[at]) > 0
        texts = [kept[a:b].decode("utf-8") if c or old[i].is_valid else None for i, (a, b, c) in enumerate(zip(cut.tolist(), cut[1:].tolist(), changed.tolist(), strict=False))]
        batch = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(texts, old.type))
        if n_chars and n_chars in batch.schema.names:
            i = batch.schema.get_field_index(n_chars)
            counts = [len(t) if c else o for t, c, o in zip(texts, changed.tolist(), batch.column(i).to_pylist(), strict=True)]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(counts, batch.schema.field(i).type))
        return batch

    return process(docs, emit, docs.schema, width, id_col, text_col)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_summary(spread_table(spark, sf_dir, "documents"))
