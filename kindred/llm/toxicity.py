"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Per-coordinate learning rates and the L1 term leave few weights other than 0, so the model is a
short list of (bucket, weight) whose size is bounded by ``BUCKETS`` and is broadcast.

Training reads about ``per_class`` labelled documents of each class, those whose ids hash below a
bound, all of a smaller class; scoring reads every byte of every text. As classes are sampled apart, the bias is
corrected to their shares among all labelled documents, so decisions don't depend on the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.shared import remainder, sampled

BUCKETS = 1 << 20
#: Offsets of the second word of each kind of pair: 1 is a bigram, the others are skip-grams.
PAIRS = (1, 2, 3)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(BUCKETS, np.float32)
        table[self.buckets] = self.weights
        return table


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, bigram and skip-gram of the rows; words are runs of letters and digits in lower case."""
    data = tw.lowered(data)
    starts, ends, word_offs = tw.word_spans(data, offs, tw.LETTERS)
    words = tw.spans_hash(data, starts, ends, tw.BASES[0])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
    rows, hashes = [row], [words]
    for gap in PAIRS:
        same = row[gap:] == row[:-gap] if gap < len(row) else np.zeros(0, bool)
        first, second = words[: len(same)][same], words[gap:][same]
        hashes.append(tw.mixed(first * np.uint64(3) + second * np.uint64(2 * gap + 5)))
        rows.append(row[: len(same)][same])
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64)


STEP = 0xFFFF


def gaps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps; a gap of ``STEP`` or more has a ``STEP`` for each time it holds one."""
    gap = np.diff(numbers, prepend=0)
    many = gap // STEP
    out = np.full(len(gap) + int(many.sum()), STEP, "<u2")
    out[np.cumsum(many + 1) - 1] = gap % STEP
    return out.tobytes()


def from_gaps(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all parts one after another, and where each part's begin: two arrays, whatever the number of parts."""
    held = [np.frombuffer(x, "<u2") for x in parts]
    offs = np.concatenate([[0], np.cumsum([np.count_nonzero(x != STEP) for x in held], dtype=np.int64)]).astype(np.int64)
    out = np.empty(offs[-1], np.int32)
    for x, begin, end in zip(held, offs[:-1], offs[1:], strict=True):
        out[begin:end] = np.cumsum(x, dtype=np.int64)[x != STEP]
    return out, offs


def presence(text: Column) -> Column:
    """The distinct buckets of each text, by their gaps."""

    @F.arrow_udf(returnType=T.BinaryType())
    def buckets(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offs in tw.slices(column):
            row, bucket = features(data, offs)
            pairs = np.unique(row * BUCKETS + bucket)
            out += [gaps(x) for x in np.split(pairs % BUCKETS, np.searchsorted(pairs // BUCKETS, np.arange(1, len(offs) - 1)))]
        return pa.array(out, pa.binary())

    return buckets(text)


def train(buckets: np.ndarray, offs: np.ndarray, labels: np.ndarray, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, passes: int = 8, weight: float = 1.5) -> Model:
    """FTRL-proximal over the presence of features, one document (``buckets[offs[i] : offs[i + 1]]``, distinct) at a time; ``weight`` multiplies the loss of label 1. Without rows, the bias is all there is."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(labels)):
            x, y = buckets[offs[i] : offs[i + 1]], float(labels[i])
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            g *= weight if y else 1.0
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    live = np.flatnonzero(np.abs(z) > l1)
    weights = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return Model(live, weights.astype(np.float32), bias)


def scores(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each row; a row without words has that of the bias."""
    out = np.full(len(texts), bias, dtype=np.float64)
    for start, _, data, offs in tw.slices(texts):
        row, bucket = features(data, offs)
        live = table[bucket] != 0
        pairs = np.unique(row[live] * BUCKETS + bucket[live])
        np.add.at(out, start + pairs // BUCKETS, table[pairs % BUCKETS].astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: int) -> DataFrame:
    """``(doc_id, text, label, weight)`` of about ``per_class`` documents of each class 0 and 1 outside the held-out fold.

    ``fold``: (modulus, held-out remainder). A document labelled twice counts with its larger label. ``weight``: the labelled
    documents of its class that each one stands for.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", fold[0]) != fold[1])).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = sampled(known.join(documents.select("doc_id").distinct(), "doc_id"), "label", per_class)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def gathered(sample: DataFrame, column: Column) -> tuple[list[pa.Buffer], np.ndarray, np.ndarray]:
    """``column`` (binary), label and weight of a bounded sample, in an order that the rows alone decide. No text comes along."""
    keys = [F.xxhash64("doc_id").alias("_a"), F.xxhash64("text").alias("_b")]
    table = sample.select(*keys, "label", "weight", column.alias("_x")).toArrow()
    order = np.lexsort([table["_b"].to_numpy(), table["_a"].to_numpy()])
    held = [x.as_buffer() for chunk in table["_x"].chunks for x in chunk]
    return [held[i] for i in order], table["label"].to_numpy()[order], table["weight"].to_numpy()[order]


def prior_shift(label: np.ndarray, weight: np.ndarray) -> float:
    """What a sample's log-odds of label 1 lack to those of all labelled documents; 0 if a class has no rows.

    Sampling by class leaves the slopes of a logistic model as they are and moves its bias by the opposite of this.
    """
    clean, toxic = (weight[label == k] for k in (0, 1))
    return float(np.log(toxic[0] / clean[0])) if len(clean) and len(toxic) else 0.0


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 6000, held_out: int = 0, modulus: int = 5) -> Model:
    """A model of ``labels.toxic`` from a bounded sample outside the held-out fold; tasks hash its texts, and only distinct buckets come to the driver."""
    rows, label, weight = gathered(labelled_sample(documents, labels, "toxic", (modulus, held_out), per_class), presence(F.col("text")))
    buckets, offs = from_gaps(rows)
    del rows
    pa.default_memory_pool().release_unused()
    model = train(buckets, offs, label)
    model.bias += prior_shift(label, weight)
    return model


def with_scores(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1 for each text; null texts count as empty. Other columns stay as they are."""
    shared = documents.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.bias))

    @F.arrow_udf(returnType=T.DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        return pa.array(scores(texts, model.table(), model.bias))

    return documents.withColumn(column, toxicity(F.col("text")))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 6000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Empty and null texts get the bias's score; repeated rows get a row each; a null id has a null
    ``held_out``; other columns of either table are not read.
    """
    model = fit(documents, labels, per_class)
    scored = with_scores(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
