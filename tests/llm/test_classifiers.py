import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import quality, toxicity
from quarryline.llm.common import fold

DATA = "/root/testdata/sf0.01"


def held_out_accuracy(spark, rows, label, threshold_column="predicted"):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    pairs = rows.join(labels, "doc_id").where("held_out").select(threshold_column, label).collect()
    return sum(r[0] == r[1] for r in pairs) / len(pairs), pairs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_quality_held_out(spark):
    rows = quality.op2_quality_classifier(spark, DATA)
    assert rows.where("score < 0 OR score > 1 OR (score >= 0.5) != (predicted = 1)").count() == 0
    assert rows.count() == 1000
    assert held_out_accuracy(spark, rows, "quality")[0] > 0.97


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_toxicity_held_out(spark):
    rows = toxicity.op8_toxicity_chain(spark, DATA)
    assert rows.where("score < 0 OR score > 1 OR (score >= 0.3) != (predicted = 1)").count() == 0
    assert rows.count() == 1000
    accuracy, pairs = held_out_accuracy(spark, rows, "toxic")
    assert accuracy > 0.95
    assert sum(r[0] for r in pairs if r[1] == 0) <= 0.02 * len(pairs)


TEXTS = ["", None, " ", "One two two.\nOne two two.", "A | B | C!!", "x" * 3000, "é è — “q” 12", "a\n\nb\n"]


def test_features_by_hand():
    batch = [t.encode() for t in TEXTS if t is not None]
    at = np.concatenate([[0], np.cumsum([len(b) for b in batch])])
    x = quality.text_features(np.frombuffer(b"".join(batch), np.uint8), at)
    f = {n: x[:, i] for i, n in enumerate(quality.FEATURES)}
    assert np.isfinite(x).all() and not x[0].any()
    two = 2  # "One two two.\nOne two two."
    assert f["log_words"][two] == pytest.approx(np.log1p(6))
    assert f["distinct_words"][two] == pytest.approx(3 / 6) and f["distinct_lines"][two] == pytest.approx(1 / 2)
    assert f["titles"][two] == pytest.approx(2 / 6)
    one = np.concatenate([quality.text_features(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in batch])
    assert np.allclose(one, x)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.learn(x, y)
    fresh = rng.normal(size=(1000, 3))
    assert ((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0))).mean() > 0.9
    assert quality.learn(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def enumerated(emit, start, move):
    """Toxic marginals and expected moves of one chain over all its state sequences."""
    n = len(emit)
    weight = {s: np.exp(start[s[0]] + sum(emit[t] * s[t] for t in range(n)) + sum(move[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=n)}
    total = sum(weight.values())
    marginal = [sum(w for s, w in weight.items() if s[t]) / total for t in range(n)]
    moves = np.array([[sum(w * sum((x, y) == (a, b) for x, y in zip(s, s[1:])) for s, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])
    return marginal, moves


@pytest.mark.parametrize("block", [1, 3, 7, toxicity.BLOCK])
def test_forward_backward_enumerated(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(block)
    lengths = [1, 2, 5, 1, 9, 3]
    start, move = rng.normal(size=2), 2 * rng.normal(size=(2, 2))
    emits = [3 * rng.normal(size=n) for n in lengths]
    new = np.concatenate([np.arange(n) == 0 for n in lengths])
    weight = np.repeat([1.0, 2, 1, 5, 3, 1], lengths)
    marginal, moves = toxicity.forward_backward(np.concatenate(emits), new, start, move, weight)
    each = [enumerated(e, start, move) for e in emits]
    assert marginal == pytest.approx(np.concatenate([m for m, _ in each]))
    assert moves == pytest.approx(sum(w * x for w, (_, x) in zip([1, 2, 1, 5, 3, 1], each)), abs=1e-9)


def by_hand(model, text):
    """Score and spans of a text: words, sentences, messages in logarithms, one after another."""
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    found = list(re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    tables = [dict(zip(p.to_pylist(), w.tolist())) for p, w in zip(model.parts, model.weight)]
    chains = []
    for i, m in enumerate(found):
        if not i or any(c in low[found[i - 1].end() : m.start()] for c in b".!?\n"):
            chains.append([])
        hits = []
        for (a, b), t in zip(toxicity.KINDS, tables):
            if (a, b) == (0, None) or len(m[0]) > abs(b or a):
                part = m[0][a:b]
                if part in t:
                    hits.append(t[part])
        chains[-1].append((m.start(), m.end(), sum(hits) + model.bias, bool(hits)))
    top, expected, spans = 0.0, 0.0, []
    for chain in chains:
        if not any(k for *_, k in chain):
            spans.append(None)
            continue
        alpha, beta = [], [np.zeros(2)]
        for t, (_, _, e, _) in enumerate(chain):
            alpha.append((model.start if not t else np.logaddexp(alpha[-1][0] + model.move[0], alpha[-1][1] + model.move[1])) + [0, e])
        for _, _, e, _ in chain[:0:-1]:
            b = beta[-1] + [0, e]
            beta.append(np.logaddexp(model.move[:, 0] + b[0], model.move[:, 1] + b[1]))
        for (a, b, _, _), x, y in zip(chain, alpha, beta[::-1]):
            p = np.exp((x + y)[1] - np.logaddexp(*(x + y)))
            top, expected = max(top, p), expected + p
            spans.append((a, b) if p >= 0.5 else None)
    runs = []
    for before, s in zip([None, *spans], spans):
        if s and before:
            runs[-1][1] = s[1]
        elif s:
            runs.append(list(s))
    top = min(max(top, 1e-4), 1 - 1e-4)
    z = model.document[0] + model.document[1] * np.log(top / (1 - top)) + model.document[2] * np.log1p(expected)
    return 1 / (1 + np.exp(-z)), runs


def test_toxicity_by_hand(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 150"))
    rng = np.random.default_rng(2)
    vocabulary = ["vileword", "vilething", "vilest", "Vile", "sun", "river", "stone.", "green!", "é", "house\n", "slow?", "x1"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(60)] + [None, "", " . ", "vilest " * 3000, "river " * 2000 + "vileword " + "sun " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in toxicity.score(df, model).collect():
        score, runs = by_hand(model, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=1e-9), r["doc_id"]
        assert [list(x) for x in zip(r["starts"], r["ends"])] == runs


def test_training_rows(spark):
    """Bounds by rows and by bytes, whole documents, repeated rows once, every text of a repeated id."""
    docs = spark.createDataFrame([(i, "a" * 100, 1) for i in range(40)] + [(3, "a" * 100, 1), (3, "b" * 100, 1), (None, "c", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(50)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    rows = lambda *bounds: toxicity.training_rows(docs, labels, "toxic", *bounds, "doc_id", "text").collect()
    assert len(rows(100, 10**6)) == 41 and len([r for r in rows(100, 10**6) if r["doc_id"] == 3]) == 2
    assert [sum(r["toxic"] == c for r in rows(7, 10**6)) <= 7 for c in (0, 1)] == [True, True]
    assert [sum(r["toxic"] == c for r in rows(100, 500)) for c in (0, 1)] == [5, 5]
    assert {len(r["text"]) for r in rows(100, 10)} == {100}


def features_by_hand(text):
    """The features of one text, from Python's own strings and counters."""
    raw = (text or "").encode()
    n = len(raw)
    space, usual = b" \t\n\x0b\x0c\r", b".,;:'-\"()"
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    other = lambda c: not (letter(c) or 48 <= c <= 57 or c in space or c in usual)
    words = raw.split()
    w = max(len(words), 1)
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    lines = raw.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    per = lambda test: sum(map(test, raw)) / max(n, 1)
    upper, lower = [sum(65 <= c <= 90 for c in x) for x in words], [sum(97 <= c <= 122 for c in x) for x in words]
    marks = {c for c in raw if 33 <= c < 127 and not chr(c).isalnum() and c not in usual}
    counts = Counter(raw)
    return [
        np.log1p(n), np.log1p(len(words)), mean, np.sqrt(max(0, sum(x * x for x in lengths) / w - mean**2)), sum(x > 14 for x in lengths) / w, len(set(words)) / w, max(Counter(words).values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, len(set(zip(words, words[1:]))) / max(w - 1, 1), per(letter), per(lambda c: 65 <= c <= 90), per(lambda c: 48 <= c <= 57), per(lambda c: c in space),
        per(other), per(lambda c: c >= 128), len(marks), sum(u > 0 and not lo and sum(map(letter, x)) > 1 for x, u, lo in zip(words, upper, lower)) / w, sum(65 <= x[0] <= 90 and lo > 0 for x, lo in zip(words, lower)) / w, sum(any(map(other, x)) for x in words) / w,
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), -sum(c / n * np.log2(c / n) for c in counts.values()), raw.count(b".") / w, sum(x <= 3 for x in lengths) / w,
    ]


def test_quality_by_hand(spark):
    """Features and scores of the query's operators, text by text; null and empty texts, repeated rows, null ids, a text of 1 MB."""
    rng = np.random.default_rng(1)
    vocabulary = ["One", "two", "TWO", "a|b", "x" * 20, "é", "12", "end.", "\n", "\n\n", "!!", "word", "word", "“q”", "(of)"]
    texts = [*TEXTS, *(" ".join(rng.choice(vocabulary, rng.integers(0, 50))) for _ in range(80)), "same", "same", "Long word " * 100_000, "\x1cA\x85b"]
    ids = [None if i in (3, 20) else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "f") for i, t in zip(ids, texts)], "doc_id long, text string, f string").repartition(3)
    known = quality.features(df)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(known, labels)
    expected = []
    for i, t in zip(ids, texts):
        f = np.array(features_by_hand(t), np.float32)
        assert quality.text_features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] == pytest.approx(f, rel=1e-4, abs=1e-5), t
    for r in known.collect():
        b = [sum(e <= x for e in edges) for x, edges in zip(r["f"], model.edges)]
        raw = model.intercept + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[model.coarse[i][b[i]], model.coarse[j][b[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        expected.append((r["doc_id"], round(1 / (1 + np.exp(-raw)), 9)))
    assert len(model.pairs) == quality.PAIRS
    assert sorted(((r["doc_id"], round(r["score"], 9)) for r in quality.score(known, model).collect()), key=repr) == sorted(expected, key=repr)


def test_pair_tables_by_hand():
    """The four leaves of a pair's tree are those of the best of all cuts."""
    rng = np.random.default_rng(0)
    g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
    best = max((sum(g[a, b].sum() ** 2 / (h[a, b].sum() + 1) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))), i, j) for i in range(1, 5) for j in range(1, 4))
    out, gain = quality._pair_leaves(g, h)
    assert gain == pytest.approx(best[0])
    assert out[0, 0] == pytest.approx(g[: best[1], : best[2]].sum() / (h[: best[1], : best[2]].sum() + 1))


def auc(pairs):
    """Share of (1, 0) pairs in which the first has the larger score; ties are halves."""
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_held_out_ranking(spark):
    """AUC and recall on held-out rows; accuracy alone would not see that few documents are toxic."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for rows, label in ((quality.op2_quality_classifier(spark, DATA), "quality"), (toxicity.op8_toxicity_chain(spark, DATA), "toxic")):
        pairs = [tuple(r) for r in rows.join(labels, "doc_id").where("held_out").select("score", label, "predicted").collect()]
        assert auc([p[:2] for p in pairs]) > 0.97
        assert np.mean([p for _, y, p in pairs if y]) > 0.9


def small(spark):
    rng = np.random.default_rng(5)
    plain = ["sun", "river", "stone", "walk", "green", "slow", "house"]
    docs = []
    for i in range(240):
        w = rng.choice(plain, 30).tolist()
        if i % 3 == 0:
            w[5], w[17] = rng.choice(["vileword", "vilething", "vilest"], 2)
        docs.append((i, " ".join(w[:15]).capitalize() + ". " + " ".join(w[15:]) + "!", int(i % 3 == 0)))
    return spark.createDataFrame([(i, t, 9) for i, t, _ in docs], "doc_id long, text string, score int"), spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")


def test_toxic_spans_and_filter(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 150"))
    text = "The river. A vilething was slow, green"
    fresh = spark.createDataFrame([(1, text, 0), (2, "The river is slow", 0), (3, None, 0), (4, "", 0), (5, "...", 0), (5, "...", 0), (None, text * 200, 0)], "doc_id long, text string, score int")
    rows = {(r["doc_id"]): r for r in toxicity.score(fresh, model).collect()}
    assert toxicity.score(fresh, model).count() == 7
    a, b = rows[1]["starts"][0], rows[1]["ends"][0]
    assert text.encode()[a:b] == b"vilething" and rows[1]["score"] > 0.3 and rows[None]["score"] > 0.3
    assert rows[2]["score"] < 0.3 and rows[3]["score"] == rows[4]["score"] == rows[5]["score"] < 0.3
    kept = toxicity.filter_toxic(fresh, model)
    assert kept.columns == fresh.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 5]


def test_no_labels(spark):
    docs, labels = small(spark)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    known = quality.features(docs)
    assert {r["score"] for r in quality.score(known, quality.fit(known, labels.limit(0), "toxic")).collect()} == {0.5}
    assert quality.features(docs.limit(0)).count() == 0 and toxicity.score(docs.limit(0), toxicity.Chain([], [])).count() == 0


def test_fold(spark):
    import zlib

    rows = spark.range(20).select("id", fold("id", 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)
