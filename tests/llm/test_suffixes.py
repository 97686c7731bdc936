import hashlib
import random

import numpy as np
import pytest

from quarryline.llm import repeats
from quarryline.llm.suffixes import SuffixSorter, suffix_array


@pytest.mark.parametrize("letters", [1, 2, 26, 256])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 50, 700])
def test_suffix_array(letters, n):
    text = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    whole = text.tobytes()
    assert suffix_array(text, 64).tolist() == sorted(range(n), key=lambda i: whole[i:])


def test_same():
    s = SuffixSorter(np.frombuffer(b"abcdefghijabcdefghij", np.uint8))
    assert s.same(np.array([0]), np.array([10]), 10).all() and s.same(np.array([0]), np.array([10]), 3).all()
    assert not s.same(np.array([0]), np.array([1]), 9).any()


def brute(docs, width):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            g = b[k : k + width]
            first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (float("inf") if i is None else i):
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=0):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdeé ") for _ in range(r.choice([20, 49, 50, 51, 200]))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = ["".join(r.choice("abcdeé ") for _ in range(r.randint(0, 90)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))]
        docs.append((i, "".join(parts)))
    long = "ab" * 400
    return [*docs, (70, docs[5][1]), (71, docs[5][1]), (72, long), (73, long), (74, None), (75, ""), (76, "z" * 300), (76, "z" * 300), (77, "z" * 120), (None, docs[7][1]), (None, "q" * 80)]


@pytest.mark.parametrize("block_bytes,parts,hot_bytes", [(1 << 20, 1, repeats.HOT_BYTES), (700, 3, repeats.HOT_BYTES), (700, 3, 0), (700, 3, 2000)])
def test_against_brute_force(spark, monkeypatch, block_bytes, parts, hot_bytes):
    monkeypatch.setattr(repeats.process, "__defaults__", (*repeats.process.__defaults__[:3], block_bytes, hot_bytes))
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(parts)
    assert sorted((tuple(r) for r in repeats.repeat_summary(df).collect()), key=repr) == brute(docs, 50)


def test_removal_keeps_columns_and_characters(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in docs if i is not None], "doc_id long, text string, lang string, n_chars long")
    out = repeats.remove_repeats(df, n_chars="n_chars")
    assert out.columns == df.columns
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert len(rows) >= 60 and all(r["n_chars"] == len(r["text"] or "") for r in rows.values())
    assert (74, None) in rows and (71, "") in rows
    spans = {r["doc_id"]: (r["starts"], r["ends"]) for r in repeats.repeat_spans(df).collect()}
    assert spans[71] == ([0], [len(docs[5][1].encode())])


def test_passage_in_many_contexts(spark, monkeypatch):
    """One passage in 20,000 contexts, and a bucket bound of a fraction of what its anchors get: no bucket of single strings comes near the whole."""
    monkeypatch.setattr(repeats.process, "__defaults__", (*repeats.process.__defaults__[:3], 100_000, 100_000))
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    side = lambda: "".join(r.choice("ijklmnop ") for _ in range(60))
    docs = [(i, side() + passage + side()) for i in range(20_000)]
    seen, cut = [], repeats._cut_strings
    monkeypatch.setattr(repeats, "_cut_strings", lambda width, n_sub: seen.append(n_sub) or cut(width, n_sub))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8, "doc_id")
    rows = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.repeat_summary(df).collect()}
    assert seen, "no bucket was hot"
    expected = {x[0]: (x[2], x[3]) for x in brute(docs, 50)}
    assert rows == expected and sum(n >= 120 for n, _ in rows.values()) == 19_999
    # single strings spread evenly, and equal ones meet
    data = np.frombuffer("".join(t for _, t in docs[:2000]).encode(), np.uint8)
    starts = (np.arange(2000)[:, None] * 240 + np.arange(190)).reshape(-1)
    share = np.bincount((repeats._string_hash(data, starts, 50) % np.uint64(40)).astype(int))
    distinct = len({data[s : s + 50].tobytes() for s in starts.tolist()})
    assert distinct > 100_000 and share.max() < 2.2 * share.mean()


@pytest.mark.parametrize("hot_bytes", [repeats.HOT_BYTES, 0, 2000])
def test_large_buckets_have_cells(spark, monkeypatch, hot_bytes):
    """Beyond a number of buckets these become larger: a block sends fewer rows than its texts have bucket sizes, with the same result, also if all or some cells are cut into strings."""
    monkeypatch.setattr(repeats.process, "__defaults__", (*repeats.process.__defaults__[:3], 3000, hot_bytes))
    monkeypatch.setattr(repeats, "PIECE_BUCKET", 100)
    monkeypatch.setattr(repeats, "ANCHOR_BUCKET", 100)
    monkeypatch.setattr(repeats, "MANY_BUCKETS", 8, raising=False)
    tables, materialize = {}, repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, name="table": tables.setdefault(name, materialize(df, name)))
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in repeats.repeat_summary(df).collect()), key=repr)
    assert got == brute(docs, 50)
    sizes = -(-sum(len((t or "").encode()) for _, t in docs) // 100)
    assert sizes > 128 and tables["pieces"].where("kind = 0").select("bucket").distinct().count() <= -(-sizes // 4)


@pytest.mark.parametrize("width", [5, 8, 50])
def test_least_of_equal(width):
    rng = np.random.default_rng(width)
    data = rng.integers(0, 2 if width < 10 else 1, 400).astype(np.uint8)
    starts = rng.permutation(400 - width)[:200]
    values = rng.integers(0, 1000, 200)
    least = {}
    for s, v in zip(starts.tolist(), values.tolist()):
        least[data[s : s + width].tobytes()] = min(v, least.get(data[s : s + width].tobytes(), v))
    assert repeats.least_of_equal(data, starts, values, width).tolist() == [least[data[s : s + width].tobytes()] for s in starts.tolist()]


def test_nulls_long_texts_and_names(spark):
    """Null ids and texts, repeated rows, a text of 2 MB, columns with the names of working columns, an empty table."""
    names = ["block", "bytes", "payload", "kind", "bucket", "size", "data"]
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(2_000_000))
    docs = [(None, None), (1, "x" * 60), (1, "x" * 60), (2, "y" + "x" * 60), (3, long), (4, long[:1_000_000] + "!"), (None, long[-100:])]
    df = spark.createDataFrame([(i, t, *names) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = repeats.remove_repeats(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["block"], r["size"]) for r in out.collect()), key=repr) == sorted(((i, t, "block", "size") for i, t in [(None, None), (1, "x" * 60), (1, "x" * 60), (2, "y"), (3, long), (4, "!"), (None, "")]), key=repr)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_empty(spark):
    assert repeats.repeat_summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0
