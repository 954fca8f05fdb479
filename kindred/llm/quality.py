"""Quality: gradient-boosted trees on histograms of document statistics.

Each tree is complete, so all trees are flattened into arrays of split features, thresholds and leaf values, and
numpy walks every document down a level of every tree at once. The arrays have a fixed size and are broadcast.

Training reads about ``per_class`` labelled documents of each class, those whose ids hash below a bound, all of a
smaller class; statistics and scores are of whole texts. The bias is corrected to the classes' shares among all labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.shared import remainder
from kindred.llm.toxicity import gathered, labelled_sample, prior_shift

TREES, DEPTH, BINS = 80, 4, 64

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#$%&*@^~+=<>_\\/",
    "bar": b"|",
    "bracket": b"()[]{}\"'",
    "high": range(128, 256),
}
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _k
NAMES = [*CLASSES, "log_bytes", "log_words", "word_length", "log_lines", "line_words", "new_words", "new_lines", "new_triples", "common_word", "capital_words", "odd_ends", "short_words", "long_words"]


def distinct(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of distinct values, and how often its most frequent one occurs."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(row)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[begin], size)
    return np.bincount(row[begin], minlength=n), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(row, statistic) as named in ``NAMES``; a row without bytes has zeros."""
    n, lengths = len(offs) - 1, np.diff(offs)
    row_of = np.repeat(np.arange(n), lengths)
    width = len(CLASSES) + 1
    counts = np.bincount(row_of * width + CLASS_OF[data], minlength=n * width).reshape(n, width)
    starts, ends, word_offs = tw.word_spans(data, offs)
    words, word_row = np.diff(word_offs), np.repeat(np.arange(n), np.diff(word_offs))
    size = ends - starts
    hashes = tw.spans_hash(data, starts, ends, tw.BASES[0])
    per_word = lambda marks: np.bincount(word_row, weights=marks, minlength=n) / np.maximum(words, 1)
    end_of_line = data == 10
    line_end = np.zeros(len(data), bool)
    line_end[end_of_line] = True
    line_end[offs[1:][lengths > 0] - 1] = True
    stop = np.flatnonzero(line_end) + 1
    line_row = np.searchsorted(offs, stop - 1, side="right") - 1
    start = np.concatenate([[0], stop[:-1]])[: len(stop)]
    lines = np.bincount(line_row, minlength=n)
    line_hash = tw.spans_hash(data, start, np.maximum(stop - end_of_line[stop - 1], start), tw.BASES[0]) if len(stop) else np.zeros(0, np.uint64)
    triple, triple_offs = tw.window_starts(word_offs, 3)
    triples = np.diff(triple_offs)
    triple_hash = tw.spans_hash(hashes, triple, triple + 3, tw.BASES[0])
    new_words, most = distinct(hashes, word_row, n)
    last = CLASS_OF[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    upper = np.concatenate([[0], np.cumsum(CLASS_OF[data] == 0)])
    capital = (upper[ends] - upper[starts]) * 2 > size
    odd = np.isin(last, [list(CLASSES).index(x) for x in ("shout", "symbol", "bar")])
    columns = [
        counts[:, : width - 1] / np.maximum(lengths, 1)[:, None],
        np.log1p(lengths),
        np.log1p(words),
        per_word(size.astype(np.float64)),
        np.log1p(lines),
        words / np.maximum(lines, 1),
        new_words / np.maximum(words, 1),
        distinct(line_hash, line_row, n)[0] / np.maximum(lines, 1),
        distinct(triple_hash, np.repeat(np.arange(n), triples), n)[0] / np.maximum(triples, 1),
        most / np.maximum(words, 1),
        per_word(capital & (size > 1)),
        per_word(odd),
        per_word(size <= 2),
        per_word(size >= 15),
    ]
    return np.column_stack(columns).astype(np.float32)


@dataclass
class Model:
    """Flat trees: inner node k of a tree has children 2k+1 and 2k+2; rows go right if the feature exceeds the threshold."""

    feature: np.ndarray  # (tree, inner node)
    threshold: np.ndarray
    value: np.ndarray  # (tree, leaf)
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.value[tree, node - inner].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.12, weight: float = 2.0, least: float = 4.0) -> Model:
    """Boosting of logistic loss: each level of a tree splits all its nodes by one histogram of gradients. Without rows, or with one class, all leaves are 0."""
    rows, n_features = x.shape
    inner = 2**DEPTH - 1
    share = float(np.clip(y.mean() if rows else 0.5, 0.01, 0.99))
    model = Model(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if not rows or len(np.unique(y)) < 2:
        return model
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0, method="lower").astype(np.float32)
    bins = np.stack([np.searchsorted(cuts[:, f], x[:, f]) for f in range(n_features)], 1)
    total = np.full(rows, model.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            key = (((node - first)[:, None] * n_features + np.arange(n_features)) * BINS + bins).ravel()
            left_g, left_h = (np.cumsum(np.bincount(key, weights=np.repeat(v, n_features), minlength=many * n_features * BINS).reshape(many, n_features, BINS), 2) for v in (g, h))
            all_g, all_h = left_g[..., -1:], left_h[..., -1:]
            gain = left_g**2 / (left_h + weight) + (all_g - left_g) ** 2 / (all_h - left_h + weight) - all_g**2 / (all_h + weight)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            gain[..., -1] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6:
                    model.feature[t, first + k], model.threshold[t, first + k] = f, cuts[b, f]
            node = 2 * node + 1 + (x[np.arange(rows), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        sums = [np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h)]
        model.value[t] = -rate * sums[0] / (sums[1] + weight)
        total += model.value[t][leaf]
    return model


def all_statistics(texts: pa.Array) -> np.ndarray:
    parts = [statistics(data, offs) for _, _, data, offs in tw.slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)


def measured(text: Column) -> Column:
    """The statistics of each text, as little-endian 32-bit floats."""

    @F.arrow_udf(returnType=T.BinaryType())
    def measure(column: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in all_statistics(column).astype("<f4")], pa.binary())

    return measure(text)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 6000, held_out: int = 2, modulus: int = 4) -> Model:
    """A model of ``labels.quality`` from a bounded sample outside the held-out fold; tasks measure its texts, and only statistics come to the driver."""
    rows, label, weight = gathered(labelled_sample(documents, labels, "quality", (modulus, held_out), per_class), measured(F.col("text")))
    x = np.frombuffer(b"".join(rows), "<f4").reshape(-1, len(NAMES))
    model = train(x, label.astype(np.float64))
    model.bias += prior_shift(label, weight)
    return model


def with_scores(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1 for each text; null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast((model.feature, model.threshold, model.value, model.bias))

    @F.arrow_udf(returnType=T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        model, x = Model(*shared.value), all_statistics(texts)
        return pa.array(np.concatenate([model.scores(x[at : at + 256]) for at in range(0, len(x), 256)] or [np.zeros(0)]))

    return documents.withColumn(column, score(F.col("text")))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 6000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Empty and null texts are scored as texts of no words; repeated rows get a row each; a null id has a null
    ``held_out``; other columns of either table are not read.
    """
    scored = with_scores(documents.select("doc_id", "text"), fit(documents, labels, per_class))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
