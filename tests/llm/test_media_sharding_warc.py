import base64
import hashlib
import io
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import media, sharding, warc


@pytest.mark.parametrize("text", ["", "a", "é" * 31 + "x", "b" * 64, "c" * 70_001])
def test_media_round_trip(text):
    stored = media.store_wav(media.pad(text.encode()))
    assert media.read_wav(stored)[0].rstrip(b"\0") == text.encode()
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
        assert w.readframes(w.getnframes()) == media.pad(text.encode())


def test_resampling_keeps_a_tone():
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = media.resample(x, 1, 2)
    assert len(y) == 8000
    spectrum = abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(int(spectrum.argmax()) - 440) <= 1 and 0.9 < abs(y[200:-200]).max() < 1.1
    high = media.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32), 1, 2)
    assert abs(high[200:-200]).max() < 0.05
    up = media.resample(x[:3000], 3, 2)
    direct = np.sin(2 * np.pi * 440 * np.arange(4500) / 24000)
    assert min(abs(up[300:4000] - direct[300 + s : 4000 + s]).max() for s in range(-3, 4)) < 0.1


def test_segments():
    e = np.array([1, 1, 9, 9, 5, 5, 9, 1, 1, 1, 9, 1], np.float32)
    a, b = media.segments(e, high=1.5, low=0.5, least=3)
    assert (a.tolist(), b.tolist()) == ([2], [7])
    assert [len(x) for x in media.segments(np.zeros(5, np.float32))] == [0, 0]


def test_media_rows(spark):
    texts = ["", None, "hello", "hello", "loud \xff" * 3000, "x" * 64]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r["doc_id"]: r for r in media.digests(df).collect()}
    for i, t in enumerate(texts):
        p = media.pad((t or "").encode())
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert rows[i]["media_sha256"] == hashlib.sha256(media.store_wav(p)).hexdigest()
    assert rows[2]["feature"] == rows[3]["feature"] != rows[4]["feature"]
    full = {r["doc_id"]: r for r in media.audio_features(media.store_media(df)).collect()}
    assert all(len(r["tensor"]) == media.N_SLOTS * media.N_MELS for r in full.values())
    assert all(full[i]["tensor"] == rows[i]["tensor"] and full[i]["seg_start_ms"] == rows[i]["seg_start_ms"] and full[i]["seg_end_ms"] == rows[i]["seg_end_ms"] for i in full)
    assert media.tensor_array([np.zeros((media.N_SLOTS, media.N_MELS), np.float32)]).type == media.tensor_type()
    assert media.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("up,down", [(3, 4), (1, 2), (2, 3), (3, 2), (320, 441)])
def test_resampler_is_the_direct_form(up, down):
    """Zeros between the samples, one long filter, every down-th output; and any range of outputs alone."""
    x = np.random.default_rng(up).normal(size=700).astype(np.float32)
    h = media.branches(up, down)
    assert h.shape[0] == up
    taps = h.T.reshape(-1).astype(np.float64)  # tap k of branch b stands at k * up + b
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)
    delay = h.shape[1] // 2 * up
    count = media.resampled_length(len(x), up, down)
    at = np.arange(count) * down + delay
    direct = np.where(at < len(full), full[np.minimum(at, len(full) - 1)], 0)
    got = media.resample(x, up, down)
    assert got == pytest.approx(direct, abs=1e-4)
    for a, b in ((0, 1), (5, 6), (17, 333), (count - 3, count)):
        assert (media.resample(x, up, down, a, b) == got[a:b]).all()


@pytest.mark.parametrize("n", [1, 256, 257, 700, 30_000])
def test_features_are_the_direct_ones(monkeypatch, n):
    """Resampled at once, each frame by a discrete Fourier transform written out, triangles from their definition, means over slots."""
    raw = (128 + 60 * np.sin(np.arange(n) / 7) * (np.arange(n) % 9000 < 4000) + np.random.default_rng(n).integers(-9, 9, n)).astype(np.uint8)
    tensor, a, b, frames = media.features(raw.tobytes(), media.RATE_IN)
    y = media.resample((raw.astype(np.float32) - 128) / 128, 3, 4).astype(np.float64)
    y = np.concatenate([y, np.zeros(media.FRAME * 2 + len(y))])
    assert frames == max(1, -(-max(0, media.resampled_length(n, 3, 4) - 256) // 128) + 1)
    k, t = np.arange(129)[:, None], np.arange(256)[None, :]
    transform = np.exp(-2j * np.pi * k * t / 256)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    power = np.array([abs(transform @ (y[f * 128 : f * 128 + 256] * hann)) ** 2 for f in range(frames)])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = [700 * (10 ** ((mel(60) + (mel(6000) - mel(60)) * i / 25) / 2595) - 1) for i in range(26)]
    bank = np.zeros((24, 129))
    for i, (lo, mid, hi) in enumerate(zip(points, points[1:], points[2:])):
        for j in range(129):
            f = j * 12_000 / 256
            bank[i, j] = max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
        if not bank[i].any():
            bank[i, np.argmin(abs(np.arange(129) * 12_000 / 256 - mid))] = 1e-3
        bank[i][bank[i] > 0] = np.maximum(bank[i][bank[i] > 0], 1e-3)
    logs = np.log(power @ bank.T + media.FLOOR)
    edge = [i * frames // 8 for i in range(9)]
    assert tensor == pytest.approx(np.array([logs[p : max(q, p + 1)].mean(0) for p, q in zip(edge, edge[1:])]), abs=2e-2)
    energy, on, spans = power.sum(1), False, []
    for f, e in enumerate([*energy, -1.0]):
        if not on and e >= media.HIGH * energy.mean():
            on, begin = True, f
        elif on and e < media.LOW * energy.mean():
            on = False
            if f - begin >= media.MIN_FRAMES:
                spans.append((begin * 128 * 1000 // 12_000, ((f - 1) * 128 + 256) * 1000 // 12_000))
    assert list(zip(a.tolist(), b.tolist())) == spans and (n < 30_000 or len(spans) == 4)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    again = media.features(raw.tobytes(), media.RATE_IN)
    assert again[0] == pytest.approx(tensor, abs=1e-5) and again[1].tolist() == a.tolist()


def test_stored_tensors(spark, tmp_path):
    """The stored column has Arrow's fixed-shape type and holds the features; null ids, repeated rows, long files and clashing names."""
    names = ["media", "tensor", "arrow", "n_bytes"]
    texts = [None, "", "abc" * 500_000, "same", "same"]
    df = spark.createDataFrame([(None if i == 3 else i, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    path = str(tmp_path / "tensors")
    media.write_tensors(media.store_media(df), path)
    seen = []
    for r in spark.read.parquet(path).collect():
        batch = media.tensor_batch(bytes(r["arrow"]))
        assert batch.column("tensor").type == media.tensor_type()
        for i, t, starts in zip(batch.column("doc_id").to_pylist(), batch.column("tensor").to_numpy_ndarray(), batch.column("seg_start_ms").to_pylist()):
            text = texts[3 if i is None else i]
            expected = media.features(media.pad((text or "").encode()), media.RATE_IN)
            assert t.shape == (8, 24) and (t == expected[0]).all() and starts == expected[1].tolist()
            seen.append(i)
    assert sorted(seen, key=str) == [0, 1, 2, 4, None] and media.read_tensors(spark, path).count() == 5


@pytest.mark.parametrize("n,parts,cell", [(0, 1, 10), (5, 3, 10), (1000, 7, 10), (333, 1, 1000)])
def test_sharding(spark, n, parts, cell):
    df = spark.createDataFrame([(i // 2, "x") for i in range(n)], "doc_id long, shard string").drop("shard").repartition(parts)
    rows = sharding.assign_shards(df, [F.col("doc_id")], 16, rows_per_cell=cell).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i // 2 for i in range(n))
    sizes = Counter(r["shard"] for r in rows)
    assert max((sizes[s] for s in range(16)), default=0) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_matrix_rows_add_up():
    counts = np.array([5, 0, 17, 40, 8])
    room = np.array([20, 20, 30])
    rows = np.stack([sharding.matrix_row(counts, room, p, 3) for p in range(5)])
    assert rows.sum(1).tolist() == counts.tolist() and rows.sum(0).tolist() == room.tolist()


def test_hypergeometric_of_large_populations(monkeypatch):
    monkeypatch.setattr(sharding, "_LIBRARY_MOST", 0)
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(rng, 300, 700, 100) for _ in range(4000)])
    assert abs(x.mean() - 30) < 0.3 and abs(x.var() - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    assert sharding.hypergeometric(rng, 3, 0, 2) == 2 and sharding.hypergeometric(rng, 0, 3, 2) == 0
    assert 0 <= sharding.hypergeometric(rng, 10**11, 10**11, 10**10) <= 10**10


def test_shuffle_is_uniform(spark):
    df = spark.range(800).withColumnRenamed("id", "doc_id").repartitionByRange(4, "doc_id")
    rows = sharding.assign_shards(df, [F.col("doc_id")], 4).collect()
    share = Counter((r["doc_id"] // 200, r["shard"]) for r in rows)
    assert all(25 < n < 75 for n in share.values())


def test_repeated_rows_are_shuffled_too(spark):
    """40 equal rows among 400: the counts by shard pass a chi-square test (15 degrees of freedom: 37.7 is the 0.1 % point), and differ by seed."""
    df = spark.createDataFrame([(7 if i % 10 == 0 else 1000 + i, None) for i in range(400)], "doc_id long, text string").repartition(5)
    every = Counter()
    for seed in range(6):
        shares = Counter(r["shard"] for r in sharding.assign_shards(df, [F.col("doc_id")], 16, seed=seed).collect() if r["doc_id"] == 7)
        assert sum((shares[s] - 2.5) ** 2 / 2.5 for s in range(16)) < 37.7
        every += shares
    assert sum((every[s] - 15) ** 2 / 15 for s in range(16)) < 37.7


def test_counts_are_the_matrix_and_names_may_clash(spark):
    """From each partition exactly the matrix's numbers of rows go to each cell; working columns do not disturb those of the input."""
    names = ["row", "part", "first", "again", "cell", "base", "__part", "__first", "__rank", "__cell", "slot", "shard"]
    df = spark.range(0, 3000, 1, 4).selectExpr("id AS doc_id", *(f"'{n}' AS {n}" for n in names))
    source = {r["doc_id"]: r["p"] for r in df.select("doc_id", F.spark_partition_id().alias("p")).collect()}
    out = sharding.assign_shards(df, [F.col("doc_id")], 3, rows_per_cell=300)
    rows = out.collect()
    assert all(r[n] == n for r in rows[:50] for n in names[:-2]) and set(out.columns) == {"doc_id", *names}
    counts = np.array([n for _, n in sorted(Counter(source.values()).items())])
    sizes, shards = sharding.cell_sizes(3000, 3, 300)
    begin = {s: np.cumsum([0, *sizes[shards == s]]) for s in range(3)}
    first = {s: int(np.flatnonzero(shards == s)[0]) for s in range(3)}
    seen = Counter((source[r["doc_id"]], first[r["shard"]] + int(np.searchsorted(begin[r["shard"]], r["slot"], "right")) - 1) for r in rows)
    for p in range(4):
        assert [seen[p, c] for c in range(len(sizes))] == sharding.matrix_row(counts, sizes, p, sharding.SEED).tolist()


def test_sharding_query(spark, tmp_path):
    """The query against its contract, row by row."""
    docs = [(1, "abc"), (1, "abc"), (None, None), (3, ""), (4, "é" * 40_000), *((i, "abc") for i in range(5, 60))]
    spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, slot string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op6_hypergeometric_sharding(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s])) for s in range(16))


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("range_bytes", [200, warc.RANGE_BYTES])
@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, range_bytes, compression):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (5, "http://c", "same"), (3, None, None), (4, "http://d e", ""), (6, "u", FAKE * 3), (7, "u", "é" * 500), (8, "v", FAKE), (9, "w", "x\r\n\r\ny"), (9, "w", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    path = str(tmp_path / "out")
    warc.write_pages(df, path, compression=compression)
    rows = warc.read_records(spark, path, range_bytes).collect()
    got = sorted((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", i))
    expected = []
    for i, _, h in pages:
        p = (h or "").encode()
        again = i != largest[h or ""]
        expected.append((f"<urn:page:{i}>", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f"<urn:page:{largest[h or '']}>" if again else None))
    assert got == sorted(expected)


def test_warc_candidates_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    found = warc.scan(record * 3 + b"WARC/1.1\r\nno length\r\n\r\n" + record[:-20])
    assert found["off"] == [0, len(record), 2 * len(record)] and found["exit"][0] == 3 * len(record)
    assert warc.scan(b"")["off"] == []


def test_only_records_are_hashed(monkeypatch):
    """A payload full of records, whose lengths reach far beyond them, is hashed once."""
    nested = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 400000\r\n\r\n" * 10_000
    whole = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(nested) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{nested}\r\n\r\n".encode() for _ in range(2))
    hashed = []
    real = hashlib.sha1
    monkeypatch.setattr(warc.hashlib, "sha1", lambda x: hashed.append(len(x)) or real(x))
    found = warc.scan(whole)
    assert hashed == [len(nested)] * 2 and len(found["off"]) > 10_000


def test_warc_null_ids_and_names(spark, tmp_path):
    names = ["digest", "bytes", "salt", "first_id", "body", "n", "value"]
    df = spark.createDataFrame([(i, u, h, *names) for i, u, h in [(None, None, "same"), (None, "u", "same"), (4, "u", "same"), (3, "u", "same"), (7, "u", "x" * 3_000_000)]], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    warc.write_pages(df, str(tmp_path / "out"))
    rows = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_records(spark, str(tmp_path / "out"), strict=True).collect())
    assert rows == [("<urn:page:3>", "revisit", 4, "<urn:page:4>"), ("<urn:page:4>", "response", 4, None), ("<urn:page:7>", "response", 3_000_000, None), ("<urn:page:>", "response", 4, None), ("<urn:page:>", "response", 4, None)]


@pytest.mark.parametrize("range_bytes", [30_000, warc.RANGE_BYTES])
def test_warc_long_url(spark, tmp_path, range_bytes):
    pages = [(i, "data:" + "WARC/1.1" * 12_500 if i in (0, 3) else f"u{i}", f"html {i}") for i in range(7)]
    path = str(tmp_path / "out")
    warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    rows = warc.read_records(spark, path, range_bytes, strict=True).collect()
    assert sorted((r["record_id"], r["payload_bytes"]) for r in rows) == [(f"<urn:page:{i}>", 6) for i in range(7)]


def test_warc_strict(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for name, data in (("middle", record * 2 + b"damage" + record), ("start", b"damage" + record)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="records end at byte" if name == "middle" else "no record at the start"):
            warc.read_records(spark, str(tmp_path / name), strict=True).collect()
    assert warc.read_records(spark, str(tmp_path / "middle")).count() == 2


def test_warc_threshold_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long text"), (4, "u", "long text")], "page_id long, url string, html string")
    warc.write_pages(df, str(tmp_path / "a"), min_bytes=5)
    assert Counter(r["record_type"] for r in warc.read_records(spark, str(tmp_path / "a")).collect()) == {"response": 3, "revisit": 1}
    warc.write_pages(df.limit(0), str(tmp_path / "b"))
    assert warc.read_records(spark, str(tmp_path / "b")).count() == 0
