import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from quarryline.llm import golay, oracles, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids):
    """Smallest id reachable over links of at most 4 bits."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def corpus(seed=0):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gámma", "d", "e1", "zeta", "eta", "theta"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 90))) for _ in range(25)]
    near = []
    for t in texts:
        w = t.split(" ")
        for _ in range(r.randint(0, 4)):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            near.append("\n ".join(v))
    return [*texts, *near, texts[0], texts[1].upper(), None, "", " \t\n", "one two", "ONE  two", "solo"]


def test_sql_against_brute_force():
    """The SQL's XXH64 on every length up to 120 and with long words, its fingerprints and groups."""
    r = random.Random(5)
    letters = "abz09é日😀-.X"
    texts = corpus() + ["".join(r.choice(letters) for _ in range(n)) for n in range(1, 121)]
    texts += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 40))) for _ in range(60)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = sorted(c.sql(oracles.SIMHASH).fetchall())
    fps = [fingerprint(t) for t in texts]
    assert got == [(i, f"{fp:016x}", least) for i, (fp, least) in enumerate(zip(fps, groups(fps, range(len(fps))), strict=True))]


def test_golay_code():
    near, far, count = golay._errors()
    assert len(np.unique(near)) == 2048 and all(int(p).bit_count() <= 3 for p in near) and count.sum() == 8855
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    assert (golay.syndrome((words ^ near[golay.syndrome(words)])) == 0).all()


@pytest.mark.parametrize("errors", range(5))
def test_keys_meet(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, oa = golay.keys(a)
    kb, ob = golay.keys(b)
    assert set(oa.tolist()) == set(range(400))
    both = set(zip(oa.tolist(), ka.tolist())) & set(zip(ob.tolist(), kb.tolist()))
    assert {o for o, _ in both} == set(range(400))


def test_join_groups_is_a_forest():
    fp = np.array([0, 1, 3, 7, 0xFFFF << 40, (0xFFFF << 40) + 1, (2**63) + (0xFF << 20), 0], np.uint64)
    key = np.array([1, 1, 1, 1, 1, 1, 1, 2])
    a, b = simhash.join_groups(key, fp)
    assert len(a) == 4 and 7 not in set(a.tolist() + b.tolist())


@pytest.mark.parametrize("rows_at_once", [simhash.ROWS_AT_ONCE, 50])
def test_against_brute_force(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", rows_at_once)
    texts = corpus()
    ids = [10 + i for i in range(len(texts))]
    ids[3], ids[-1] = None, None
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string").repartition(3)
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()), key=repr)
    fps = [fingerprint(t) for t in texts]
    assert got == sorted(((i, format(f, "016x"), c) for i, f, c in zip(ids, fps, groups(fps, ids))), key=repr)


def test_keep_one(spark):
    texts = corpus(1)
    ids = [10 + i for i in range(len(texts))]
    fps = [fingerprint(t) for t in texts]
    expected = sorted(i for i, c in zip(ids, groups(fps, ids)) if i == c)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)] + [(10, texts[0], "x", 1)], "doc_id long, text string, lang string, n_chars long")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == expected
    alone = spark.createDataFrame([(None, "nothing like it at all"), (None, texts[0]), (10, texts[0])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(alone).collect()) == sorted([(0, "nothing like it at all"), (10, texts[0])])


def test_keep_one_of_each_group(spark):
    """An id on texts of two groups, an id whose text belongs to a group of another name, and copies without an id."""
    a, b, c = "one two three four five six", "nothing like it at all here", "a third text of other words"
    rows = [(1, a), (1, b), (2, b), (2, b), (None, c), (None, c), (None, a)]
    out = simhash.keep_one(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, a, 7), (1, b, 7), (None, c, 7)], key=repr)


def test_clashing_names_and_odd_tables(spark):
    """Working columns do not disturb the input's; an empty table, one of nulls, and a table whose losers are joined by a shuffle."""
    a, b = "one two three four five six", "nothing like it at all here"
    names = ["id", "fp", "__id", "__fp", "ID_", "link", "component_id", "n", "c", "doc"]
    df = spark.createDataFrame([(i, t, *names) for i, t in [(1, a), (2, a), (None, a), (3, b), (3, b), (None, None)]], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([(1, a, *names), (3, b, *names), (None, None, *names)], key=repr)
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_losers_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    test_keep_one(spark)
    test_keep_one_of_each_group(spark)


def hamming_groups(fps):
    """Component numbers of fingerprints linked at 4 or fewer bits, by comparing all of them with all in blocks."""
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        for a in range(0, len(fps), 256):
            close = np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]) <= 4
            new[a : a + 256] = np.where(close, label[None, :], len(fps)).min(1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


@pytest.mark.parametrize("errors", range(5))
def test_further_keys_meet(errors):
    """Two fingerprints that share a key with at most 2 errors outside the third segment meet again."""
    rng = np.random.default_rng(errors)
    for p, (i, j) in enumerate(golay.PAIRS):
        first, width = golay.SEGMENTS[3 - i - j]
        a = rng.integers(0, 2**64, 200, dtype=np.uint64)
        b = a.copy()
        for r in range(len(b)):
            for bit in rng.choice(width, errors, replace=False):
                b[r] ^= np.uint64(1) << np.uint64(first + bit)
        key = np.full(200, p << 24)
        met = [set(zip(of.tolist(), k.tolist())) for k, of in (golay.further_keys(a, key), golay.further_keys(b, key))]
        assert {o for o, _ in met[0] & met[1]} == set(range(200))


@pytest.mark.parametrize("rows_at_once", [simhash.ROWS_AT_ONCE, 500])
def test_long_keys(spark, monkeypatch, rows_at_once):
    """Thousands of fingerprints that agree in two segments, some chains among them, with a small bound for long keys."""
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", rows_at_once)
    monkeypatch.setattr(simhash, "LONG_KEY", 200)
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 21, 1500, dtype=np.uint64) << np.uint64(43), rng.integers(0, 1 << 22, 800, dtype=np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    known = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(known).collect()}
    assert [got[int(f)] for f in fps.view(np.int64)] == hamming_groups(fps).tolist()


def test_a_key_of_50_000(spark):
    """50,000 fingerprints under one key: its rows are dealt out, and the groups are those of a comparison within windows of the third segment."""
    rng = np.random.default_rng(4)
    third = rng.choice(1 << 21, 50_000, replace=False).astype(np.uint64)
    key, of = golay.further_keys(third << np.uint64(43), np.zeros(50_000, np.int64))
    assert np.bincount(np.unique(key, return_inverse=True)[1]).max() < 2_000 and len(key) < 50 * 50_000
    known = spark.createDataFrame([(i, int(f)) for i, f in enumerate((third << np.uint64(43)).view(np.int64))], "doc_id long, fp long").repartition(8)
    # one word in 42 of all words of 21 bits, chosen by chance: each has some 180 neighbours, and all are one group
    assert {r["component_id"] for r in simhash.classes(known).collect()} == {0}


@pytest.mark.parametrize("operator", [simhash.simhash_groups, simhash.keep_one])
def test_no_links_beyond_the_keys(spark, operator):
    with pytest.raises(ValueError, match="at most 4 bits"):
        operator(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bits=5)


def test_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
