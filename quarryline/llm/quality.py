"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are computed in one pass and kept in a narrow table.
The model is learned on the driver from a bounded sample of labelled rows: in
turn, each feature gets a shallow tree on its binned values, whose leaf values
are added to the feature's lookup table (cyclic boosting); the pairs of
features that lower the loss most then get two-dimensional tables the same way.
A score is the sum of table entries, looked up for a whole batch at once.

Defined results: null and empty texts have zero features and get a score; very
long texts are read whole; documents with a null id get a score and are never
learned from; labels that are null are not used, several labels of a document
count as their largest; equal hashes are resolved by id; without any usable
label every score is 0.5; repeated rows repeat; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks, fold, slices, spread_table, table

#: Labelled rows that the model is learned from, at most: those with the smallest hashes.
TRAIN_ROWS = 20_000
ROUNDS, RATE, LEAVES = 150, 0.15, 3
PAIRS, PAIR_ROUNDS, PAIR_BINS = 8, 60, 8
BINS = 32
#: Rows of training data and hessian a leaf needs.
LEAST_HESSIAN = 2.0
FOLDS, HELD_OUT = 3, 1

FEATURES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "distinct_words", "top_word", "repeats", "distinct_pairs", "letters", "upper", "digits", "spaces",
    "other", "beyond_ascii", "distinct_others", "capitals", "titles", "words_with_other", "lines", "distinct_lines", "mean_line", "entropy", "stops", "short_words",
]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features (texts x ``FEATURES``) of texts given as bytes, with array operations over all of them."""
    n, size = len(at) - 1, len(data)
    nbytes = np.diff(at)
    doc = np.repeat(np.arange(n), nbytes)
    per = lambda mask: np.bincount(doc, weights=mask, minlength=n)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    high, digit = data >= 128, (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    letter = upper | lower | high
    usual = np.isin(data, np.frombuffer(b".,;:'-\"()", np.uint8))
    other = ~(letter | digit | space | usual)

    histogram = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    p = histogram / np.maximum(nbytes, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    marks = histogram[:, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-\"()"]]

    inside = ~space
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < size]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    stop = np.append(inside[1:] ^ True, True) if size else np.zeros(0, bool)
    stop[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    word_doc = doc[starts]
    length = ends - starts
    words = np.bincount(word_doc, minlength=n)
    mean = _ratio(np.bincount(word_doc, weights=length, minlength=n), words)
    square = _ratio(np.bincount(word_doc, weights=length**2, minlength=n), words)
    ids = slices(data, starts, ends).dictionary_encode().indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
    ids = ids.astype(np.int64)
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    pairs, times = np.unique(word_doc * vocabulary + ids, return_counts=True)
    pair_doc = pairs // vocabulary
    distinct = np.bincount(pair_doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, pair_doc, times)
    adjacent = word_doc[1:] == word_doc[:-1]
    repeats = np.bincount(word_doc[1:][adjacent & (ids[1:] == ids[:-1])], minlength=n)
    both = np.unique((word_doc[1:] * vocabulary + ids[1:])[adjacent].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[:-1][adjacent].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)[1]
    distinct_pairs = np.bincount(word_doc[1:][adjacent][both], minlength=n)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    in_word = lambda mask: (c := sums(mask))[ends] - c[starts]
    uppers, lowers, others, letters = in_word(upper), in_word(lower), in_word(other), in_word(letter)
    caps = np.bincount(word_doc[(uppers > 0) & (lowers == 0) & (letters > 1)], minlength=n)
    titles = np.bincount(word_doc[upper[starts] & (lowers > 0)] if len(starts) else [], minlength=n)

    newline = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([begins, newline[newline + 1 < size] + 1])).astype(np.int64)
    line_end = np.append(line_start[1:], size)
    line_end = line_end[: len(line_start)]
    line_end = line_end - (data[line_end - 1] == 10)  # without the line feed
    line_doc = doc[line_start] if size else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    line_ids = slices(data, line_start, line_end).dictionary_encode().indices.to_numpy().astype(np.int64) if len(line_start) else np.zeros(0, np.int64)
    line_n = int(line_ids.max()) + 1 if len(line_ids) else 1
    distinct_lines = np.bincount(np.unique(line_doc * line_n + line_ids) // line_n, minlength=n)

    columns = [
        np.log1p(nbytes), np.log1p(words), mean, np.sqrt(np.maximum(0, square - mean**2)), _ratio(np.bincount(word_doc[length > 14], minlength=n), words), _ratio(distinct, words), _ratio(top, words),
        _ratio(repeats, words), _ratio(distinct_pairs, np.maximum(words - 1, 1)), _ratio(per(letter), nbytes), _ratio(per(upper), nbytes), _ratio(per(digit), nbytes), _ratio(per(space), nbytes),
        _ratio(per(other), nbytes), _ratio(per(high), nbytes), (marks > 0).sum(1), _ratio(caps, words), _ratio(titles, words), _ratio(np.bincount(word_doc[others > 0], minlength=n), words),
        np.log1p(lines), _ratio(distinct_lines, lines), _ratio(nbytes, lines), entropy, _ratio(histogram[:, 46], words), _ratio(np.bincount(word_doc[length <= 3], minlength=n), words),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Additive:
    """Bin edges and a lookup table for each feature, and tables for pairs on coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.intercept)
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a shallow tree on ordered bins with gradient sums ``g`` and hessian sums ``h``: best splits, one after another."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    while len(cuts) <= leaves:
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = np.arange(a + 1, b)
            k = k[(H[k] - H[a] >= LEAST_HESSIAN) & (H[b] - H[k] >= LEAST_HESSIAN)]
            if len(k):
                gain = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(k[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree with one cut of each of two axes (four leaves), and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    k, m = len(g), g.shape[1]
    quads = lambda S: (S[:-1, :-1], S[:-1, -1:] - S[:-1, :-1], S[-1:, :-1] - S[:-1, :-1], S[-1, -1] - S[:-1, -1:] - S[-1:, :-1] + S[:-1, :-1])
    value = [a / (b + 1.0) for a, b in zip(quads(G), quads(H), strict=True)]
    gain = sum(a * v for a, v in zip(quads(G), value, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty((k, m))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (v[i, j] for v in value)
    return out, float(gain[i, j])


def learn(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Additive:
    """Logistic loss, Newton leaf values."""
    if not len(y) or y.min() == y.max():
        return Additive(0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), edges, [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    raw = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _leaves(np.bincount(b[:, j], weights=y - p, minlength=len(t)), np.bincount(b[:, j], weights=p * (1 - p), minlength=len(t)), leaves)
            t += step
            raw += step[b[:, j]]
    model.coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    c = [m[b[:, j]] for j, m in enumerate(model.coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = 1 / (1 + np.exp(-raw)), c[i] * PAIR_BINS + c[j]
        return tuple(np.bincount(cell, weights=w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - p, p * (1 - p)))

    ranked = sorted(((-_pair_leaves(*sums(i, j))[1], i, j) for i in range(len(c)) for j in range(i)), key=lambda z: z)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _pair_leaves(*sums(i, j))[0]
            t += step
            raw += step[c[i], c[j]]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f: the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            x = text_features(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))], ["doc_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, f array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(known: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, **options) -> Additive:
    """``known``: doc_id and f. Learns from at most ``train_rows`` labelled rows, those whose ids have the smallest hashes; rows alike in id and features count once."""
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = known.join(F.broadcast(sample), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(train_rows).orderBy("doc_id", "f").toArrow()  # at most train_rows ids are broadcast
    x = np.concatenate([_matrix(c) for c in rows.column("f").chunks]) if rows.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return learn(x.astype(np.float64), rows.column("y").to_numpy().astype(np.float64), **options)


def score(known: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score of the rows of ``features``."""
    shared = known.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch.column("f"))), pa.float64())], ["doc_id", "score"])

    return known.mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(features(spread_table(spark, sf_dir, "documents")), "features")
    labels = table(spark, sf_dir, "labels")
    model = fit(known, labels.where(fold("doc_id", FOLDS) != HELD_OUT))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(known, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
