"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: in the labelled sample,
features of words (the word, its prefixes and suffixes) are counted in toxic
and clean documents, and a token of a toxic document is toxic if one of its
features is far more frequent there.  On all sentences of the sample a
two-state chain is trained by gradient ascent on its likelihood
(forward-backward); sentences without any known feature differ in length only,
so they are sent to the driver as counts of lengths.  To score a text,
forward-backward gives each token's marginal; the largest marginal and the
expected number of toxic tokens are mapped to the document's score by a
logistic regression, and runs of likely tokens are the offending spans.

Chains are whole sentences, whatever their length: many chains are computed as
one sequence that starts anew at each of them, in blocks side by side, whose
entries are told from block to block (see ``forward_backward``).

The sample is bounded by ``TRAIN_ROWS`` documents and ``TRAIN_BYTES`` of text of
each class, in the order of hashes; documents are taken whole.  Everything else
looks at all of it.

Defined results: null and empty texts, and texts without words, get the score
of a text without a toxic token, and no spans; very long texts are scored
whole; documents with a null id are scored and never learned from; labels that
are null are not used, several labels of a document count as their largest;
equal hashes are resolved by id; repeated rows repeat, and are learned from
once; without toxic and clean labels every score is 0; empty tables give no
rows; further columns, whatever their names, are kept by ``filter_toxic`` and
ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks, fold, slices, spread_table, table, words

#: Labelled documents of each class that the model is learned from, at most, and bytes of their texts: those with the smallest hashes.
TRAIN_ROWS, TRAIN_BYTES = 5_000, 32 << 20
LEAST_COUNT, LEAST_ODDS, TOKEN_ODDS = 4, 1.5, 2.5
EPOCHS, STEP, DECAY = 120, 0.3, 1e-4
#: Document score from which a text is toxic, and marginal from which a token is.
THRESHOLD, TOKEN_THRESHOLD = 0.3, 0.5
#: Tokens of a block of ``forward_backward``, about.
BLOCK = 256
FOLDS, HELD_OUT = 4, 2

#: Kinds of features: (first byte, past-the-end byte) of the word; a part must be shorter than the word.
KINDS: list[tuple[int, int | None]] = [(0, None), (0, 4), (0, 5), (0, 6), (0, 7), (-3, None), (-4, None), (-5, None)]

SCORES = "doc_id long, score double, n_toxic long, starts array<long>, ends array<long>"


def word_parts(vocabulary: pa.Array) -> list[pa.Array]:
    """For each kind the part of every word, or null if the word is not longer."""
    out = []
    length = pc.binary_length(vocabulary)
    for first, last in KINDS:
        if (first, last) == (0, None):
            out.append(vocabulary)
            continue
        part = pc.binary_slice(vocabulary, first, last)
        out.append(pc.if_else(pc.greater(length, abs(last or first)), part, pa.scalar(None, vocabulary.type)))
    return out


@dataclass
class Chain:
    """``parts[k]``: known features of kind k; ``weight[k]``: their weights for the toxic state; the other state has weight 0."""

    parts: list[pa.Array] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    bias: float = -10.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of the logistic regression: intercept, and weights of the summary's two numbers; None: not trained.
    document: np.ndarray | None = None

    def emissions(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's weight for the toxic state without the bias, and whether any feature is known."""
        total, known = np.zeros(len(vocabulary)), np.zeros(len(vocabulary), bool)
        for part, values, weight in zip(word_parts(vocabulary), self.parts, self.weight, strict=True):
            if len(values):
                at = pc.fill_null(pc.index_in(part, value_set=values), -1).to_numpy(zero_copy_only=False)
                hit = at >= 0
                total[hit] += weight[at[hit]]
                known |= hit
        return total, known


def _scan(first: np.ndarray, out: np.ndarray, inner: np.ndarray, fresh: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """r[t] = scale[t] * (out[0] + out[1] * x) / (inner[0] + inner[1] * x) with x = r[t - 1], or scale[t] * first where ``fresh``.

    The sequence is cut into blocks that are walked side by side, twice: first
    each block's map from its entry to its exit (products of 2 x 2 matrices),
    then, with the entries known, the values.
    """
    n = len(scale)
    steps = min(n, BLOCK)
    width = -(-n // steps)
    fill = steps * width - n
    e = np.concatenate([scale, np.ones(fill)]).reshape(width, steps).T.copy()
    new = np.concatenate([fresh, np.ones(fill, bool)]).reshape(width, steps).T.copy()
    p, q, s, t = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for k in range(steps):
        top = e[k] * np.where(new[k], 0.0, out[1] * p + out[0] * s), e[k] * np.where(new[k], first, out[1] * q + out[0] * t)
        low = np.where(new[k], 0.0, inner[1] * p + inner[0] * s), np.where(new[k], 1.0, inner[1] * q + inner[0] * t)
        size = top[0] + top[1] + low[0] + low[1]
        p, q, s, t = top[0] / size, top[1] / size, low[0] / size, low[1] / size
    entry = np.empty(width)
    x = 1.0
    for b, (p1, q1, s1, t1) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        entry[b] = x
        x = min(max((p1 * x + q1) / max(s1 * x + t1, 1e-300), 1e-150), 1e150)
    r, x = np.empty((steps, width)), entry
    for k in range(steps):
        x = e[k] * np.where(new[k], first, (out[0] + out[1] * x) / (inner[0] + inner[1] * x))
        r[k] = x
    return r.T.reshape(-1)[:n]


def forward_backward(emit: np.ndarray, new: np.ndarray, start: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For chains one after another, which begin where ``new``, with toxic-state scores ``emit``: each token's marginal of the toxic state, and the expected moves (2 x 2), each token's times its weight.

    Ratios of the two states stand for messages, so nothing overflows.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e, a = np.exp(np.clip(emit, -30, 30)), np.exp(np.clip(move, -30, 30))
    ahead = _scan(np.exp(start[1] - start[0]), (a[0, 1], a[1, 1]), (a[0, 0], a[1, 0]), new, e)
    # backwards the sequence of e[t] * b[t] is walked, where b[t] is the ratio behind t; at a chain's last token it is 1
    last = np.append(new[1:], True)
    behind = _scan(1.0, (a[1, 0], a[1, 1]), (a[0, 0], a[0, 1]), last[::-1], e[::-1])[::-1] / e
    both = ahead * behind
    marginal = both / (1 + both)
    inner = np.flatnonzero(~new)
    r, x = ahead[inner - 1], e[inner] * behind[inner]
    w = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * x, a[1, 0] * r, a[1, 1] * r * x])
    w *= (1.0 if weight is None else weight[inner]) / w.sum(0)
    return marginal, w.sum(1).reshape(2, 2)


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of all chains: words of a text between sentence ends."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = (data == 46) | (data == 33) | (data == 63) | (data == 10)
    upto = np.concatenate([[0], np.cumsum(stop)])
    new = np.ones(n, bool)
    new[1:] = upto[starts[1:]] > upto[ends[:-1]]
    new[first[:-1][first[:-1] < n]] = True
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, n))


def marginals(model: Chain, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginal of every word whose chain has a known feature (0 elsewhere), and whether it has."""
    n = len(starts)
    out, known_word = np.zeros(n), np.zeros(n, bool)
    if not n:
        return out, known_word
    coded = slices(data, starts, ends).dictionary_encode()
    which = coded.indices.to_numpy()
    weight, known = model.emissions(coded.dictionary)
    begin, length = sentences(data, starts, ends, first)
    known_word = np.repeat(np.bitwise_or.reduceat(known[which], begin), length)
    new = np.zeros(n, bool)
    new[begin] = True
    out[known_word], _ = forward_backward(weight[which[known_word]] + model.bias, new[known_word], model.start, model.move)
    return out, known_word


def summary(marginal: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: logit of the largest marginal, and log of the expected number of toxic tokens among chains with known features."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    top = np.zeros(n)
    m = np.where(known, marginal, 0.0)
    np.maximum.at(top, doc, m)
    expected = np.bincount(doc, weights=m, minlength=n)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(expected)], axis=1)


def document_score(model: Chain, x: np.ndarray) -> np.ndarray:
    if model.document is None:
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(model.document[0] + x @ model.document[1:], -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, part, toxic, clean): in how many documents words with this part occur, word by word."""
    for batch, data, at in chunks(batches):
        low, starts, ends, first = words(data, at)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        if not len(starts):
            continue
        coded = slices(low, starts, ends).dictionary_encode()
        size = len(coded.dictionary)
        pairs = np.unique(doc * size + coded.indices.to_numpy())
        word, is_toxic = pairs % size, toxic[pairs // size] == 1
        n1 = np.bincount(word[is_toxic], minlength=size)
        n0 = np.bincount(word[~is_toxic], minlength=size)
        for kind, part in enumerate(word_parts(coded.dictionary)):
            t = pa.table({"part": part, "toxic": n1, "clean": n0}).filter(pc.is_valid(part)).group_by("part").aggregate([("toxic", "sum"), ("clean", "sum")])
            t = pa.table({"kind": pa.array(np.full(t.num_rows, kind, np.int32)), "part": t["part"].cast(pa.binary()), "toxic": t["toxic_sum"], "clean": t["clean_sum"]})
            yield from t.combine_chunks().to_batches()


SENTENCES = "n long, times long, token array<long>, feature array<long>, toxic array<long>"


def _sentences(model: Chain):
    """Sentences with known features: places and numbers of the features, and places of toxic tokens. Of the others how often each length occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *map(len, model.parts)])
        for batch, data, at in chunks(batches):
            low, starts, ends, first = words(data, at)
            if not len(starts):
                continue
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False) == 1, np.diff(first))
            coded = slices(low, starts, ends).dictionary_encode()
            which = coded.indices.to_numpy()
            parts = [pc.fill_null(pc.index_in(p, value_set=v), -1).to_numpy(zero_copy_only=False) if len(v) else np.full(len(p), -1) for p, v in zip(word_parts(coded.dictionary), model.parts, strict=True)]
            odds = np.full(len(coded.dictionary), -np.inf)
            for p, w in zip(parts, model.weight, strict=True):
                odds[p >= 0] = np.maximum(odds[p >= 0], w[p[p >= 0]])
            begin, length = sentences(low, starts, ends, first)
            chain = np.repeat(np.arange(len(begin)), length)
            bad = np.flatnonzero((odds[which] >= TOKEN_ODDS) & toxic)
            token, feature = [], []
            for k, p in enumerate(parts):
                x = p[which]
                own = np.flatnonzero(x >= 0)
                token.append(own)
                feature.append(x[own] + base[k])
            token, feature = np.concatenate(token), np.concatenate(feature).astype(np.int64)
            order = np.argsort(token, kind="stable")
            token, feature = token[order], feature[order]
            own = np.unique(chain[token])
            lists = lambda c, values: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(chain[c], own), len(c)), pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(length[own]), pa.array(np.ones(len(own), np.int64)), lists(token, token - begin[chain[token]]), lists(token, feature), lists(bad, bad - begin[chain[bad]])], ["n", "times", "token", "feature", "toxic"])
            n, times = np.unique(np.delete(length, own), return_counts=True)
            none = pa.array([[]] * len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times), none, none, none], ["n", "times", "token", "feature", "toxic"])

    return run


def train_chain(model: Chain, n: np.ndarray, times: np.ndarray, token: pa.ListArray, feature: pa.ListArray, toxic: pa.ListArray) -> None:
    """Adam on the chains' mean log-likelihood; sets the model's weights."""
    sizes = [len(p) for p in model.parts]
    begin = np.cumsum(n) - n
    of = lambda lists: np.repeat(begin, np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
    cell, which = of(token), feature.flatten().to_numpy()
    y = np.zeros(int(n.sum()), np.int64)
    y[of(toxic)] = 1
    new = np.zeros(len(y), bool)
    new[begin] = True
    weight = np.repeat(times, n).astype(np.float64)
    rows, inner = int(times.sum()), np.flatnonzero(~new)
    seen = np.bincount(2 * y[inner - 1] + y[inner], weights=weight[inner], minlength=4).reshape(2, 2)
    begun = np.bincount(y[begin], weights=times, minlength=2)
    theta = np.concatenate([np.zeros(sum(sizes)), [-2.0], np.zeros(2), np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = sum(sizes)
    for step in range(1, EPOCHS + 1):
        emit = np.bincount(cell, weights=theta[which], minlength=len(y)) + theta[k]
        marginal, moves = forward_backward(emit, new, theta[k + 1 : k + 3], theta[k + 3 :].reshape(2, 2), weight)
        miss = weight * (y - marginal)
        starts = float((times * marginal[begin]).sum())
        g = np.concatenate([np.bincount(which, weights=miss[cell], minlength=k), [miss.sum()], begun - [rows - starts, starts], (seen - moves).reshape(-1)])
        g = g / rows - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + STEP * (1 - step / (EPOCHS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    ends = np.cumsum([0, *sizes])
    model.weight = [theta[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    model.bias, model.start, model.move = float(theta[k]), theta[k + 1 : k + 3], theta[k + 3 :].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method; intercept first."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * np.array([1e-6, *[0.01] * (len(w) - 1)])
        w = w + np.linalg.solve(h + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * np.array([0, *[0.01] * (len(w) - 1)]) * w)
    return w


def _summaries(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            low, starts, ends, first = words(data, at)
            x = summary(*marginals(model, low, starts, ends, first), first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], ["doc_id", "a", "b", "toxic"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, train_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, toxic: of each class the labelled documents with the smallest hashes, as many as the bounds allow; rows alike in id and text once."""
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    ids = usable.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).union(usable.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * train_rows ids are broadcast
    known = narrow.select("doc_id", "toxic", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "h"]
    told = known.where("toxic = 1").orderBy(*order).limit(train_rows).collect() + known.where("toxic = 0").orderBy(*order).limit(train_rows).collect()  # numbers, not texts
    chosen, used = [], {0: 0, 1: 0}
    for r in told:
        used[r["toxic"]] += r["bytes"]
        if used[r["toxic"]] <= max(train_bytes, r["bytes"]):
            chosen.append((r["doc_id"], r["h"]))
    picked = spark.createDataFrame(chosen, "doc_id long, h long")
    return narrow.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", train_bytes: int = TRAIN_BYTES) -> Chain:
    """Learns from the rows of ``training_rows``."""
    rows = materialize(training_rows(docs, labels, label, train_rows, train_bytes, id_col, text_col), "toxic-train")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Chain([pa.array([], pa.large_binary())] * len(KINDS), [np.zeros(0)] * len(KINDS))
    if len(n) < 2:
        return model
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    counted = rows.mapInArrow(_count, "kind int, part binary, toxic long, clean long").groupBy("kind", "part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # every feature that occurs often enough in the sample; their number is bounded by its bytes
    lexicon = counted.where(F.col("toxic") >= LEAST_COUNT).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy("kind", "part").select("kind", "part", "odds").toArrow()
    kind, value = lexicon.column("kind").to_numpy(), lexicon.column("odds").to_numpy()
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        model.parts[k], model.weight[k] = lexicon.column("part").combine_chunks().take(pa.array(own)).cast(pa.large_binary()), value[own]
    parts = rows.mapInArrow(_sentences(model), SENTENCES)
    plain = parts.where(F.size("token") == 0).groupBy("n").agg(F.sum("times").alias("times")).select("n", "times", *(F.array().cast("array<long>").alias(c) for c in ("token", "feature", "toxic")))
    told = parts.where(F.size("token") > 0).union(plain).orderBy("n", "token", "feature", "toxic").toArrow().combine_chunks()
    if not told.num_rows:
        return model
    column = lambda c: told.column(c).chunk(0)
    train_chain(model, column("n").to_numpy(), column("times").to_numpy(), column("token"), column("feature"), column("toxic"))
    known = rows.mapInArrow(_summaries(model), "doc_id long, a double, b double, toxic int").orderBy("doc_id", "a", "b").toPandas()
    model.document = logistic(known[["a", "b"]].to_numpy(), known["toxic"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCORES``: the score of each text, and byte offsets of its toxic spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            low, starts, ends, first = words(data, at)
            m, known = marginals(shared.value, low, starts, ends, first)
            bad = (m >= TOKEN_THRESHOLD) & known
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            begins = bad.copy()
            begins[1:] &= ~(bad[:-1] & (doc[1:] == doc[:-1]))
            closes = bad.copy()
            closes[:-1] &= ~(bad[1:] & (doc[1:] == doc[:-1]))
            a, b = np.flatnonzero(begins), np.flatnonzero(closes)
            runs = np.bincount(doc[a], minlength=batch.num_rows)
            cut = pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int32())
            spans = [pa.ListArray.from_arrays(cut, pa.array(x - at[doc[a]], pa.int64())) for x in (starts[a], ends[b])]
            n = np.bincount(doc[bad], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(document_score(shared.value, summary(m, known, first))), pa.array(n, pa.int64()), *spans], ["doc_id", "score", "n_toxic", "starts", "ends"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORES)


def filter_toxic(docs: DataFrame, model: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, text_col):
            low, starts, ends, first = words(data, at)
            s = document_score(shared.value, summary(*marginals(shared.value, low, starts, ends, first), first))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", FOLDS) != HELD_OUT))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic")
