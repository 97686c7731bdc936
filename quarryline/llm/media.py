"""Audio features of binary media columns.

``store_wav`` puts bytes into an 8-bit PCM WAV file (one byte, one sample) and
``read_wav`` takes them out again; ``store_media`` writes such files to a table.
``audio_features`` decodes each file, resamples it with a polyphase filter (3/4
of the rate, three branches), computes overlapped log-mel filterbanks and an
energy segmentation with hysteresis, and gives one row per file: a tensor of a
fixed shape (``N_SLOTS`` x ``N_MELS`` float32, the mean log-mel energies of equal
slots of time) and the time spans of the active segments.  ``write_tensors``
stores them as Arrow streams whose tensor column has Arrow's fixed-shape type;
``read_tensors`` and ``tensor_batch`` read them back.

Everything about a file is computed from its own samples with element-wise
operations in blocks of a fixed number of frames, so equal files have equal
features whatever they are batched with.  Besides the file itself memory holds
one number for each frame (about a fortieth of the file).

Defined results: null and empty payloads are stored as one unit of zero bytes;
a file without samples has a tensor of the floor value and no spans; very long
files are read whole; rows with a null id, and repeated rows, are stored like
any other; equal energies are on the side of the threshold they reach; an empty
table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path
from .common import chunks, spread_table

#: Bytes are padded with zeros to a positive multiple of this.
UNIT = 64
RATE_IN, RATE_OUT = 16_000, 12_000
#: Taps of the anti-aliasing filter for each polyphase branch.
TAPS = 8
FRAME, HOP, N_FFT, N_MELS, N_SLOTS = 256, 128, 256, 24, 8
FRAMES_AT_ONCE = 1024
#: A segment begins above HIGH and ends below LOW (energies of a frame, relative to the file's mean), and lasts MIN_FRAMES at least.
HIGH, LOW, MIN_FRAMES = 1.15, 0.95, 3
FLOOR = 1e-6

MEDIA = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, media binary, tensor array<float>, seg_start_ms array<long>, seg_end_ms array<long>, n_frames long"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, seg_start_ms array<long>, seg_end_ms array<long>"


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + bytes(-len(payload) % unit if payload else unit)


def store_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono PCM."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(odd)


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file of unsigned 8-bit mono PCM; further chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError(f"not 8-bit mono PCM: format {kind}, {channels} channels, {bits} bits")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache
def branches(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass filter dealt to ``up`` polyphase branches of ``taps`` coefficients each (times down/up when it has to cut more)."""
    width = taps * max(1, -(-down // up))
    n = width * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(width, up).T.astype(np.float32)


def _samples(x: np.ndarray) -> np.ndarray:
    """Unsigned 8-bit samples as floats; floats as they are."""
    return (x.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else x.astype(np.float32)


def resampled_length(n: int, up: int, down: int) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, up: int, down: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Rational resampling, outputs ``first`` to ``last``: output n comes from branch n * down % up around input n * down // up. Beyond its ends the input is silent."""
    last = resampled_length(len(x), up, down) if last is None else last
    if up == down:
        return _samples(x[first:last])
    if last <= first:
        return np.zeros(0, np.float32)
    h = branches(up, down)
    width = h.shape[1]
    left, right = first * down // up + width // 2 - width + 1, (last - 1) * down // up + width // 2 + 1
    part = np.zeros(right - left, np.float32)
    a, b = max(left, 0), min(right, len(x))
    if b > a:
        part[a - left : b - left] = _samples(x[a:b])
    out = np.empty(last - first, np.float32)
    for r in range(min(up, last - first)):
        n, count = first + r, len(range(r, last - first, up))
        branch, at = n * down % up, n * down // up + width // 2 - left
        acc = np.zeros(count, np.float32)
        for k in range(width):
            acc += h[branch, k] * part[at - k : at - k + down * (count - 1) + 1 : down]
        out[r::up] = acc
    return out


@lru_cache
def mel_bands(rate: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangular filters as (bins, weights, where each band begins): band b sums weights * power[bins]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), N_MELS + 2) / 2595) - 1)
    freq = np.arange(N_FFT // 2 + 1) * rate / N_FFT
    bins, weights, begin = [], [], []
    for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
        w = np.maximum(0, np.minimum((freq - lo) / (mid - lo), (hi - freq) / (hi - mid)))
        own = np.flatnonzero(w > 0)
        if not len(own):
            own = np.array([int(np.argmin(abs(freq - mid)))])
        begin.append(len(bins))
        bins += own.tolist()
        weights += np.maximum(w[own], 1e-3).tolist()
    return np.array(bins), np.array(weights, np.float32), np.array(begin)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, up: int = 1, down: int = 1, rate: int = RATE_OUT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First frame, log-mel energies (frames x ``N_MELS``) and energies of overlapped frames of the resampled signal, some frames at once; the last frame is filled up with zeros."""
    bins, weights, begin = mel_bands(rate)
    n = resampled_length(len(x), up, down)
    frames = frame_count(n)
    for a in range(0, frames, FRAMES_AT_ONCE):
        b = min(frames, a + FRAMES_AT_ONCE)
        signal = resample(x, up, down, a * HOP, min(n, (b - 1) * HOP + FRAME))
        signal = np.concatenate([signal, np.zeros((b - 1 - a) * HOP + FRAME - len(signal), np.float32)])
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * _WINDOW, N_FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield a, np.log(np.add.reduceat(power[:, bins] * weights, begin, axis=1) + FLOOR), np.add.reduceat(power, [0], axis=1)[:, 0]


def frame_count(n: int) -> int:
    """Overlapped frames of n samples, one at least."""
    return max(1, -(-max(0, n - FRAME) // HOP) + 1)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW, least: int = MIN_FRAMES) -> tuple[np.ndarray, np.ndarray]:
    """Hysteresis: a segment begins where the energy passes ``high`` times the mean and lasts until it falls below ``low`` times the mean. First and past-the-end frames."""
    mean = float(energy.astype(np.float64).mean()) if len(energy) else 0.0
    if mean <= FLOOR:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    state = np.where(energy >= high * mean, 1, np.where(energy < low * mean, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = (known >= 0) & (state[np.maximum(known, 0)] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = b - a >= least
    return a[keep], b[keep]


def slot_edges(frames: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end frames of ``N_SLOTS`` equal parts of the time, with repeated frames where there are fewer."""
    at = np.arange(N_SLOTS + 1) * frames // N_SLOTS
    return at[:-1], np.maximum(at[1:], at[:-1] + 1)


def features(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Tensor (``N_SLOTS`` x ``N_MELS``), segment starts and ends in milliseconds, and the number of frames."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return np.full((N_SLOTS, N_MELS), np.log(FLOOR), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    g = int(np.gcd(rate, RATE_OUT))
    up, down = RATE_OUT // g, rate // g
    frames = frame_count(resampled_length(len(x), up, down))
    lo, hi = slot_edges(frames)
    total, energy = np.zeros((N_SLOTS, N_MELS)), np.empty(frames, np.float32)
    for first, mels, e in log_mel(x, up, down):
        energy[first : first + len(e)] = e
        upto = np.concatenate([np.zeros((1, N_MELS)), np.cumsum(mels, axis=0, dtype=np.float64)])
        a, b = np.clip(lo - first, 0, len(e)), np.clip(hi - first, 0, len(e))
        total += upto[b] - upto[a]
    a, b = segments(energy)
    return (total / (hi - lo)[:, None]).astype(np.float32), a * HOP * 1000 // RATE_OUT, ((b - 1) * HOP + FRAME) * 1000 // RATE_OUT, frames


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (N_SLOTS, N_MELS))


def tensor_array(flat: list[np.ndarray]) -> pa.ExtensionArray:
    """A fixed-shape Arrow tensor array of the files' features."""
    values = np.concatenate([x.reshape(-1) for x in flat]) if flat else np.zeros(0, np.float32)
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(values, pa.float32()), N_SLOTS * N_MELS))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``MEDIA``: each text's bytes, padded, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            whole = data.tobytes()
            files = [store_wav(pad(whole[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MEDIA)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[tuple]]]:
    """Rows of ``MEDIA``, their samples, and (tensor, starts, ends, frames) of each."""
    for batch, _, _ in chunks(batches, "media"):
        payloads, rows = [], []
        for media in batch.column("media"):
            samples, rate = read_wav(media.as_py())
            payloads.append(samples)
            rows.append(features(samples, rate))
        yield batch, payloads, rows


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tolist() for x in values], pa.list_(pa.int64()))


def audio_features(media: DataFrame) -> DataFrame:
    """``RESULT`` of the rows of ``MEDIA``: each file's tensor (row by row) and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, rows in _decoded(batches):
            tensor, a, b, frames = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, tensor_array(list(tensor)).storage.cast(pa.list_(pa.float32())), _lists(a), _lists(b), pa.array(frames, pa.int64())], [x.split(" ")[0] for x in RESULT.split(", ")])

    return media.mapInArrow(run, RESULT)


def write_tensors(media: DataFrame, path: str) -> None:
    """Features of the rows of ``MEDIA`` as a table of Arrow streams (``arrow binary``), a batch each: doc_id, n_bytes, tensor (fixed shape), spans, frames, and digests of the file and of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch, payloads, rows in _decoded(batches):
            tensor, a, b, frames = zip(*rows, strict=True)
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": pa.array([len(x) for x in payloads], pa.int64()), "payload_sha256": pa.array([sha(x) for x in payloads]),
                "tail_crc32": pa.array([zlib.crc32(x[-UNIT:]) for x in payloads], pa.int64()), "media_bytes": pc.binary_length(batch.column("media")).cast(pa.int64()), "media_sha256": pa.array([sha(x.as_py()) for x in batch.column("media")]),
                "tensor": tensor_array(list(tensor)), "seg_start_ms": _lists(a), "seg_end_ms": _lists(b), "n_frames": pa.array(frames, pa.int64()),
            }
            sink = pa.BufferOutputStream()
            told = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            with pa.ipc.new_stream(sink, told.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(told)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["arrow"])

    media.mapInArrow(run, "arrow binary").write.parquet(path)


def tensor_batch(stream: bytes) -> pa.RecordBatch:
    """A stream that ``write_tensors`` has stored; its column ``tensor`` is of ``tensor_type``."""
    with pa.ipc.open_stream(stream) as r:
        return r.read_next_batch()


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """``DIGEST`` of what ``write_tensors`` has stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in DIGEST.split(", ")]
        for batch in batches:
            for stream in batch.column("arrow"):
                told = tensor_batch(stream.as_py())
                tensor = told.column("tensor").to_numpy_ndarray()
                spans = zip(told.column("seg_start_ms").to_pylist(), told.column("seg_end_ms").to_pylist(), strict=True)
                text = [feature_text(t, a, b, n) for t, (a, b), n in zip(tensor, spans, told.column("n_frames").to_pylist(), strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(tensor) + 1) * N_SLOTS * N_MELS, pa.int32()), pa.array(tensor.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(text) if c == "feature" else flat if c == "tensor" else told.column(c) for c in names], names)

    return spark.read.parquet(path).mapInArrow(run, DIGEST)


def feature_text(tensor: np.ndarray, a: list[int], b: list[int], frames: int) -> str:
    """A digest of the features: number of frames and segments, active time, the tensor's values to a tenth."""
    tenths = np.rint(np.float64(tensor) * 10).astype(np.int64).tobytes()
    return f"frames={frames};segments={len(a)};active_ms={sum(b) - sum(a)};logmel={hashlib.sha256(tenths).hexdigest()[:16]}"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DIGEST``: files and tensors are written to the shared folder, and read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tensors")
    write_tensors(materialize(store_media(docs, id_col, text_col), "media"), path)
    return read_tensors(spark, path)


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread_table(spark, sf_dir, "documents"))
