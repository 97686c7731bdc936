import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quarryline.llm import decontamination
from quarryline.llm.word_suffixes import WordSuffixArray

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(window, len(w)) + 1 if w else 0):
            patterns.setdefault(tuple(w[k : k + window]), set()).add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, seed=0):
    r = random.Random(seed)
    text = lambda n, v: " ".join(r.choice(["Alpha", "béta", "x1", "y", "ZZ"][:v]) + r.choice(["", ",", "-"]) for _ in range(n))
    items = [(1, text(25, 3)), (2, text(12, 2)), (3, "Short item"), (4, ""), (5, None), (10, text(10, 3)), (6, "Short item"), (None, "alpha ZZ zz"), (None, "x1-x1, x1 x1")]
    docs = [(i, text(r.randint(0, 120), 3)) for i in range(40)] + [(50, None), (51, ""), (52, "a SHORT, item b"), (52, "a SHORT, item b"), (53, items[0][1] + " tail"), (54, "... !!"), (None, items[1][1])]
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, n_words string")
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 20])
def test_against_brute_force(spark, block_words):
    docs, items, d, b = tables(spark)
    got = sorted((tuple(r) for r in decontamination.contamination(d, b, block_words=block_words).collect()), key=repr)
    assert got == brute(docs, items)


def test_window_beyond_one_key(spark):
    docs, items, d, b = tables(spark, 3)
    assert sorted((tuple(r) for r in decontamination.contamination(d, b, window=4).collect()), key=repr) == brute(docs, items, 4)


def test_remove_and_matches(spark):
    docs, items, d, b = tables(spark)
    clean = {r[0] for r in brute(docs, items) if not r[5]}
    kept = decontamination.remove(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == clean
    found = decontamination.matches(d, b).where("doc_id = 53 AND item_id = '1' AND doc_word = 0").collect()
    assert [(r["item_word"], r["n_words"]) for r in found] == [(0, 25)]


def brute_matches(docs, items, window):
    out = []
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            for a in range(len(v)):
                for b in range(len(w)):
                    if (not a or not b or v[a - 1] != w[b - 1]) and v[a] == w[b]:
                        n = 0
                        while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                            n += 1
                        if n >= min(window, len(v)):
                            out.append((d, None if i is None else str(i), a, b, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,block_words", [(10, decontamination.BLOCK_WORDS), (3, 20)])
def test_matches_against_brute_force(spark, window, block_words):
    docs, items, d, b = tables(spark, 1)
    assert sorted((tuple(r) for r in decontamination.matches(d, b, window, block_words=block_words).collect()), key=repr) == brute_matches(docs, items, window)


@pytest.mark.parametrize("seed", range(4))
def test_word_suffix_array(seed):
    """The order of all suffixes, each up to its next 0, and every pattern's range in it."""
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, [3, 2, 50, 4][seed], 400)
    if seed == 3:
        tokens = np.concatenate([np.tile([1, 2, 3, 1, 1], 40), [0], np.tile([1, 2, 3, 1, 1], 40), [0]])
    array = WordSuffixArray(tokens, [300, 2, 50, 1 << 20][seed])
    upto = lambda i: tuple(itertools.takewhile(bool, tokens[i:].tolist()))
    assert [upto(i) for i in array.suffixes] == sorted(upto(i) for i in range(len(tokens)) if tokens[i])
    begin = array.suffixes[::7]
    length = np.minimum(array.run[begin], rng.integers(1, 9, len(begin)))
    levels = range(-(-9 // array.per_key))
    lo, hi = array.ranges([array.packed(begin, k, length) for k in levels], [array.packed(begin, k, length, True) for k in levels])
    for a, b, i, n in zip(lo, hi, begin, length):
        pattern = upto(i)[:n]
        assert sorted(array.suffixes[a:b]) == [j for j in range(len(tokens)) if tokens[j] and upto(j)[:n] == pattern]


def test_very_long_texts_and_repeated_words(spark):
    items = [(1, "la " * 300), (2, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "La, " * 100_000), (2, "x " * 200_000 + items[1][1] + " y" * 100_000), (3, "la " * 9), (None, None)]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.contamination(d, b).collect()}
    assert rows == {1: (100_000, 100_000, 1), 2: (300_011, 11, 1), 3: (9, 0, 0), None: (0, 0, 0)}
    assert sorted(r["doc_id"] or 0 for r in decontamination.remove(d, b).collect()) == [0, 3]


def test_empty(spark):
    _, _, d, b = tables(spark)
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert not decontamination.contamination(d, b.limit(0)).where("contaminated").count()
