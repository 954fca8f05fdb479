"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It labels every byte of every
text with a distribution over the languages; a document's distribution is the mean over all its
bytes. A text is cut into segments of ``SEGMENT`` bytes that are run side by side, so memory is
bounded by the batch, whatever the length of a text, and no byte is left out.

Training reads about ``per_language`` documents of each language (those whose ids hash below a
bound, all of a smaller language) and random segments of them; labelling reads everything.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.shared import free_name, remainder, sampled

HIDDEN = 8
SEGMENT = 96
#: Segments that are run side by side.
WIDTH = 2048
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    languages: list[str]
    weights: Weights = field(default_factory=dict)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent, which numpy computes faster than exp and a division."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def initial(n_languages: int, rng: np.random.Generator) -> Weights:
    w: Weights = {}
    for way in "fb":
        for gate in "zrn":
            w[f"x{gate}{way}"] = rng.normal(0, 0.3, (256, HIDDEN))
            w[f"h{gate}{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, HIDDEN))
        w[f"o{way}"] = rng.normal(0, 0.3, (HIDDEN, n_languages))
    w["bias"] = np.zeros(n_languages)
    return {k: v.astype(np.float32) for k, v in w.items()}


def run(seg: np.ndarray, w: Weights, way: str, live: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, row, unit) of one direction over segments (time, row). Padding, where ``live`` is 0, leaves the state at 0."""
    steps, n = seg.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if way == "f" else reversed(range(steps)):
        x = seg[t]
        z = _sigmoid(w[f"xz{way}"].take(x, axis=0) + h @ w[f"hz{way}"])
        r = _sigmoid(w[f"xr{way}"].take(x, axis=0) + h @ w[f"hr{way}"])
        cand = np.tanh(w[f"xn{way}"].take(x, axis=0) + (r * h) @ w[f"hn{way}"])
        if keep is not None:
            keep.append((t, h, z, r, cand))
        h = cand + z * (h - cand)
        if live is not None:
            h *= live[t][:, None]
        out[t] = h
    return out


def swift(seg: np.ndarray, w: Weights, way: str, live: np.ndarray | None) -> np.ndarray:
    """What ``run`` gives, computed in place in few small arrays that stay in the processor's cache."""
    steps, n = seg.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    tables = {gate: (w[f"x{gate}{way}"] * (1.0 if gate == "n" else np.float32(0.5)), w[f"h{gate}{way}"] * (1.0 if gate == "n" else np.float32(0.5))) for gate in "zrn"}
    z, r, cand, part = (np.empty_like(h) for _ in range(4))
    for t in range(steps) if way == "f" else reversed(range(steps)):
        x = seg[t]
        for gate, to in (("z", z), ("r", r)):
            table, mix = tables[gate]
            table.take(x, axis=0, out=to, mode="clip")
            np.matmul(h, mix, out=part)
            to += part
            np.tanh(to, out=to)
            to *= 0.5
            to += 0.5
        r *= h
        table, mix = tables["n"]
        table.take(x, axis=0, out=cand, mode="clip")
        np.matmul(r, mix, out=part)
        cand += part
        np.tanh(cand, out=cand)
        h -= cand
        h *= z
        h += cand
        if live is not None:
            h *= live[t][:, None]
        out[t] = h
    return out


def distributions(seg: np.ndarray, live: np.ndarray, w: Weights) -> np.ndarray:
    """For each row of segments (time, row), the sum over its live bytes of the distribution over languages."""
    steps, n = seg.shape
    k = len(w["bias"])
    total = np.zeros((n, k), np.float32)
    masked = None if live.all() else live
    ahead, back = swift(seg, w, "f", masked), swift(seg, w, "b", masked)
    for t in range(0, steps, 2):
        logits = ahead[t : t + 2].reshape(-1, HIDDEN) @ w["of"]
        logits += back[t : t + 2].reshape(-1, HIDDEN) @ w["ob"]
        logits += w["bias"]
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits /= logits @ np.ones((k, 1), np.float32)
        logits = logits.reshape(-1, n, k)
        if masked is not None:
            logits *= live[t : t + 2][:, :, None]
        total += logits.sum(0)
    return total


def gradients(seg: np.ndarray, target: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean loss over all positions of segments (time, row) and its gradients, by backpropagation through time."""
    steps, n = seg.shape
    g = {k: np.zeros_like(v) for k, v in w.items()}
    kept: dict[str, list] = {"f": [], "b": []}
    states = {way: run(seg, w, way, keep=kept[way]) for way in "fb"}
    logits = states["f"] @ w["of"] + states["b"] @ w["ob"] + w["bias"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    rows = np.arange(n)
    loss = float(-np.log(p[:, rows, target] + 1e-9).mean())
    p[:, rows, target] -= 1
    p /= steps * n
    g["bias"] = p.sum((0, 1))
    for way in "fb":
        g[f"o{way}"] = np.einsum("tnh,tnk->hk", states[way], p, optimize=True)
        into = p @ w[f"o{way}"].T
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, cand in reversed(kept[way]):
            dh = dh + into[t]
            d_cand = dh * (1 - z) * (1 - cand * cand)
            d_z = dh * (h - cand) * z * (1 - z)
            d_rh = d_cand @ w[f"hn{way}"].T
            d_r = d_rh * h * r * (1 - r)
            for gate, d, state in (("z", d_z, h), ("r", d_r, h), ("n", d_cand, r * h)):
                np.add.at(g[f"x{gate}{way}"], seg[t], d)
                g[f"h{gate}{way}"] += state.T @ d
            dh = dh * z + d_rh * r + d_z @ w[f"hz{way}"].T + d_r @ w[f"hr{way}"].T
    return loss, g


def train(texts: list[bytes], targets: np.ndarray, languages: list[str], steps: int = 260, width: int = 384, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam over random segments, as many of each language. With fewer than two languages there is nothing to learn."""
    rng = np.random.default_rng(seed)
    if len(languages) < 2:
        return Model(languages)
    w = initial(len(languages), rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    by = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, targets, strict=True) if y == k and t] for k in range(len(languages))]
    length = SEGMENT * 2 // 3
    for step in range(1, steps + 1):
        target = np.arange(width) % len(languages)
        seg = np.full((length, width), 32, np.uint8)
        for i, k in enumerate(target):
            doc = by[k][rng.integers(len(by[k]))]
            at = int(rng.integers(max(1, len(doc) - length + 1)))
            part = np.resize(doc[at : at + length], length)
            seg[:, i] = part
        _, g = gradients(seg, target, w)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        pace = rate * min(1.0, step / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def pooled(data: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """The mean distribution over languages of each row's bytes; a row without bytes has the uniform one."""
    k, lengths = len(model.languages), np.diff(offs)
    total = np.zeros((len(lengths), k))
    if k == 1:
        return np.ones((len(lengths), 1))
    if not k:
        return total
    counts = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offs[:-1][row] + nth * SEGMENT
    size = np.minimum(SEGMENT, offs[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), WIDTH):
        part = order[at : at + WIDTH]
        grid = start[part][None, :] + np.arange(size[part[0]])[:, None]
        live = (np.arange(size[part[0]])[:, None] < size[part][None, :]).astype(np.float32)
        np.add.at(total, row[part], distributions(data.take(grid, mode="clip"), live, model.weights))
    return np.where(lengths[:, None] > 0, total / np.maximum(lengths, 1)[:, None], 1 / k)


def labelled_sample(documents: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` training documents of each language: not held out, with text and language."""
    known = documents.where("text is not null and text <> '' and lang is not null and doc_id is not null").where(remainder("doc_id", 5) != 0)
    ids = sampled(known.select("doc_id", "lang").distinct(), "lang", per_language)
    return known.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"]).orderBy("lang", F.xxhash64("doc_id"), "doc_id")


def fit(documents: DataFrame, per_language: int = 500) -> Model:
    """A model of ``lang`` from a bounded sample of the training folds."""
    sample = labelled_sample(documents, per_language).select("text", "lang").toArrow()
    named = sample["lang"].to_pylist()
    languages = sorted(set(named))
    place = {x: i for i, x in enumerate(languages)}
    return train([x.encode() for x in sample["text"].to_pylist()], np.array([place[x] for x in named], dtype=np.int64), languages)


def with_languages(documents: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the language predicted and its pooled probability in the columns so named."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    @F.arrow_udf(returnType=T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def labelled(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b, data, offs in tw.slices(texts, 1 << 21):
            p = pooled(data, offs, model)
            if p.shape[1]:
                best[a:b], score[a:b] = p.argmax(1), np.minimum(p.max(1), 1.0)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        return pa.StructArray.from_arrays([pa.array(names[best if model.languages else best - 1], pa.string()), pa.array(score)], ["lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    both = free_name([*documents.columns, language, score], "_found")
    found = documents.withColumn(both, labelled(F.col("text")))
    named = F.when(letters, F.col(f"{both}.lang_pred")).otherwise(F.lit(UNKNOWN))
    return found.withColumns({language: named, score: F.when(letters, F.col(f"{both}.score")).otherwise(F.lit(0.0))}).drop(both)


def languages(documents: DataFrame, per_language: int = 500) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    A null text or one without a letter is ``und`` with score 0, and so is every text where no
    labelled row exists to learn from. Repeated rows get a row each; a null id has a null ``held_out``.
    """
    found = with_languages(documents.select("doc_id", "text"), fit(documents, per_language))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
