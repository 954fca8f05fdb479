"""Training of an encoder, and of a decoder beside it, by triplets and reconstruction: data-parallel gradient descent.

Rows are packed into mini-batches once, one row of a table each, in a folder a step. A step reads its folder; each task takes its mini-batches forward through the net, mines their triplets, and takes the loss
backward, in numpy. What leaves a task is one sum of gradients, in chunks, which a second stage adds up; the driver holds the net and the state of its optimiser, sizes that the net alone decides.
Noise (dropout) depends on seed, epoch, step and mini-batch, so a task that is run again gives the same gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.encoder import Decoder, Encoder, Layer
from kindred.operators.training import SIDES, _squared, labels_apart, mined, mixed_loss, with_close_labels

#: Numbers of a gradient that are added up together.
CHUNK = 1 << 18
#: What a variance, and each component of a difference, is increased by.
EPSILON, DISTANCE_EPSILON, MOMENTUM = 1e-5, 1e-6, 0.1


@dataclass
class Block:
    """A linear layer; all but the last of a net normalise their outputs by batch and bend them (PReLU with one slope)."""

    weight: np.ndarray
    bias: np.ndarray
    gamma: np.ndarray | None = None
    beta: np.ndarray | None = None
    slope: np.ndarray | None = None
    mean: np.ndarray | None = None
    variance: np.ndarray | None = None

    LEARNED = ("weight", "bias", "gamma", "beta", "slope")

    @classmethod
    def random(cls, rng: np.random.Generator, inputs: int, outputs: int, hidden: bool) -> Block:
        bound = 1 / np.sqrt(inputs)
        block = cls(rng.uniform(-bound, bound, (outputs, inputs)), rng.uniform(-bound, bound, outputs))
        if hidden:
            block.gamma, block.beta, block.slope, block.mean, block.variance = np.ones(outputs), np.zeros(outputs), np.full(1, 0.25), np.zeros(outputs), np.ones(outputs)
        return block

    def learned(self) -> list[str]:
        return [n for n in self.LEARNED if getattr(self, n) is not None]

    def frozen(self) -> Layer:
        if self.gamma is None:
            return Layer(self.weight, self.bias)
        return Layer(self.weight, self.bias, self.mean, self.gamma / np.sqrt(self.variance + EPSILON), self.beta, np.full(len(self.bias), float(self.slope[0])))


def _forward(blocks: list[Block], x: np.ndarray, drops: list[float], rng: np.random.Generator) -> tuple[np.ndarray, list[dict]]:
    kept = []
    for block, drop in zip(blocks, drops, strict=True):
        mask = (rng.random(x.shape) >= drop) / (1 - drop) if drop else None
        x = x if mask is None else x * mask
        held = {"mask": mask, "x": x}
        x = x @ block.weight.T + block.bias
        if block.gamma is not None:
            mean, variance = x.mean(0), x.var(0)
            root = np.sqrt(variance + EPSILON)
            held |= {"mean": mean, "variance": variance, "root": root, "normal": (x - mean) / root}
            x = held["normal"] * block.gamma + block.beta
            held["bent"] = x
            x = np.where(x >= 0, x, block.slope * x)
        kept.append(held)
    return x, kept


def _backward(blocks: list[Block], kept: list[dict], g: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    grads = []
    for block, held in zip(reversed(blocks), reversed(kept), strict=True):
        own = {}
        if block.gamma is not None:
            low = held["bent"] < 0
            own["slope"] = np.array([(g * held["bent"])[low].sum()])
            g = np.where(low, block.slope * g, g)
            own["gamma"], own["beta"] = (g * held["normal"]).sum(0), g.sum(0)
            g = g * block.gamma
            g = (g - g.mean(0) - held["normal"] * (g * held["normal"]).mean(0)) / held["root"]
        own["weight"], own["bias"] = g.T @ held["x"], g.sum(0)
        g = g @ block.weight
        if held["mask"] is not None:
            g = g * held["mask"]
        grads.append(own)
    return g, grads[::-1]


@dataclass
class Settings:
    margin: float = 0.05
    mode: str = "semihard"
    #: The share of the triplets' loss; the rest is the reconstruction's.
    triplet_weight: float = 0.5
    input_dropout: float = 0.4
    dropout: float = 0.5
    seed: int = 0


@dataclass
class Net:
    """An encoder whose outputs have length 1, and a decoder of the mirrored sizes."""

    encoder: list[Block] = field(default_factory=list)
    decoder: list[Block] = field(default_factory=list)

    @classmethod
    def random(cls, n_genes: int, hidden: list[int], latent: int, seed: int = 0) -> Net:
        rng, sizes = np.random.default_rng(seed), [n_genes, *hidden, latent]
        make = lambda s: [Block.random(rng, a, b, k < len(hidden)) for k, (a, b) in enumerate(zip(s[:-1], s[1:], strict=True))]
        return cls(make(sizes), make(sizes[::-1]))

    def blocks(self) -> list[Block]:
        return [*self.encoder, *self.decoder]

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(b, n).ravel() for b in self.blocks() for n in b.learned()])

    def with_parameters(self, flat: np.ndarray) -> None:
        at = 0
        for b in self.blocks():
            for n in b.learned():
                old = getattr(b, n)
                setattr(b, n, flat[at : at + old.size].reshape(old.shape).copy())
                at += old.size

    def frozen(self) -> tuple[Encoder, Decoder]:
        """What embeds and rebuilds rows after training."""
        return Encoder([b.frozen() for b in self.encoder]), Decoder([b.frozen() for b in self.decoder])

    def losses(self, x: np.ndarray, ids: np.ndarray, code: np.ndarray, apart: np.ndarray, study: np.ndarray, settings: Settings, rng: np.random.Generator, triplets: list | None = None) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
        """(losses, gradient of their mix by all parameters, mean and variance of each hidden layer) of one mini-batch, sorted by id. ``triplets`` are mined unless given."""
        first, rest = settings.input_dropout, settings.dropout
        y, kept = _forward(self.encoder, x, [first, *[rest] * (len(self.encoder) - 2), 0.0][-len(self.encoder) :], rng)
        size = np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)
        z = y / size
        rebuilt, kept_back = _forward(self.decoder, z, [0.0, *[rest] * (len(self.decoder) - 2), 0.0][-len(self.decoder) :], rng)
        difference = rebuilt - x
        mse = float((difference**2).mean())
        g, by_decoder = _backward(self.decoder, kept_back, (1 - settings.triplet_weight) * 2 * difference / difference.size)
        if triplets is None:
            triplets = mined(_squared(z), z, ids, code, apart, study, settings.margin, settings.mode, settings.seed)
        loss, n = 0.0, len(triplets)
        if n:
            a, p, m = (np.array([t[k] for t in triplets]) for k in range(3))
            near, far = z[a] - z[p] + DISTANCE_EPSILON, z[a] - z[m] + DISTANCE_EPSILON
            d_near, d_far = (np.sqrt((d * d).sum(1)) for d in (near, far))
            each = np.maximum(d_near - d_far + settings.margin, 0)
            loss, live = float(each.mean()), (each > 0)[:, None] * settings.triplet_weight / n
            by_near, by_far = live * near / d_near[:, None], live * far / d_far[:, None]
            np.add.at(g, a, by_near - by_far)
            np.add.at(g, p, -by_near)
            np.add.at(g, m, by_far)
        g = (g - z * (g * z).sum(1, keepdims=True)) / size
        _, by_encoder = _backward(self.encoder, kept, g)
        gradient = np.concatenate([own[name].ravel() for b, own in zip(self.blocks(), [*by_encoder, *by_decoder], strict=True) for name in b.learned()])
        unbiased = len(x) / max(len(x) - 1, 1)
        moments = [np.concatenate([h["mean"], h["variance"] * unbiased]) for h in [*kept, *kept_back] if "mean" in h]
        mixed = mixed_loss(loss, mse, settings.triplet_weight)
        return {"loss": mixed, "triplet_loss": loss, "mse": mse, "triplets": float(n)}, gradient, np.concatenate(moments) if moments else np.zeros(0)

    def moved(self, moments: np.ndarray) -> None:
        """Running means and variances after a step's mean ones."""
        at = 0
        for b in self.blocks():
            if b.gamma is not None:
                n = len(b.bias)
                b.mean = (1 - MOMENTUM) * b.mean + MOMENTUM * moments[at : at + n]
                b.variance = (1 - MOMENTUM) * b.variance + MOMENTUM * moments[at + n : at + 2 * n]
                at += 2 * n


NUMBERS = ("loss", "triplet_loss", "mse", "triplets")


def minibatches(rows: DataFrame, path: str, workers: int = 1, related: DataFrame | None = None) -> DataFrame:
    """Writes rows (batch, cell_id, label, study, idx, val) as one row for each mini-batch and reads them again; ``workers`` of them make a step.

    A mini-batch has a bounded number of rows, sorted by cell_id. ``related`` (a, b) are labels of which neither is a negative for the other. Rows without a label take no part.
    """
    held = with_close_labels(rows.where("label is not null"), related).select("batch", F.struct(F.col("cell_id").cast("long").alias("cell_id"), F.col("label").cast("string").alias("label"), F.col("study").cast("string").alias("study"), F.col("_close").alias("close"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<float>").alias("val")).alias("row"))
    packed = held.groupBy("batch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    packed = packed.withColumn("step", F.floor(F.col("batch") / workers).cast("int"))
    packed.repartition("step", "batch").write.partitionBy("step").parquet(path)
    return rows.sparkSession.read.schema(packed.schema).parquet(path)


def _inputs(rows: pa.StructArray, n_genes: int) -> tuple[np.ndarray, ...]:
    """(dense matrix, ids, label numbers, which labels are apart, study numbers) of a mini-batch."""
    idx, val = rows.field("idx"), rows.field("val")
    x = np.zeros((len(rows), n_genes))
    np.add.at(x, (np.repeat(np.arange(len(rows)), np.asarray(idx.value_lengths())), np.asarray(idx.flatten())), np.asarray(val.flatten(), dtype=np.float64))
    code, apart = labels_apart(rows.field("label"), rows.field("close").to_pylist())
    return x, np.asarray(rows.field("cell_id")), code, apart, rows.field("study").dictionary_encode().indices.fill_null(-1).to_numpy()


def _step(batches: DataFrame, net: Net, settings: Settings, epoch: int) -> np.ndarray:
    """The mean over a step's mini-batches of (losses, gradient, moments), one after another."""
    spark = batches.sparkSession
    shared = spark.sparkContext.broadcast((net, settings))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, options = shared.value
        total = None
        for part in parts:
            for i in range(len(part)):
                batch, rows = part.column(0)[i].as_py(), part.column(1)[i].values
                rng = np.random.default_rng([options.seed, epoch, batch])
                numbers, gradient, moments = held.losses(*_inputs(rows, held.encoder[0].weight.shape[1]), options, rng)
                own = np.concatenate([[1.0, *(numbers[n] for n in NUMBERS)], gradient, moments])
                total = own if total is None else total + own
        for at in range(0, 0 if total is None else len(total), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], ["chunk", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, np.float64) for x in rows["sums"].to_pylist()], axis=0)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "chunk int, sums binary"
    found = batches.select(F.col("batch").cast("long").alias("batch"), "rows").mapInArrow(work, schema).groupBy("chunk").applyInArrow(add, schema).toArrow().sort_by("chunk")
    shared.destroy()
    whole = np.concatenate([np.frombuffer(x, np.float64) for x in found["sums"].to_pylist()]) if len(found) else np.zeros(1)
    return whole[1:] / max(whole[0], 1)


@dataclass
class AdamW:
    """Adam with decoupled decay of the parameters."""

    decay: float = 0.01
    first: float = 0.9
    second: float = 0.999
    steps: int = 0
    mean: np.ndarray | None = None
    square: np.ndarray | None = None

    def moved(self, flat: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.mean = np.zeros_like(flat) if self.mean is None else self.mean
        self.square = np.zeros_like(flat) if self.square is None else self.square
        self.steps += 1
        self.mean = self.first * self.mean + (1 - self.first) * gradient
        self.square = self.second * self.square + (1 - self.second) * gradient**2
        unbiased = self.mean / (1 - self.first**self.steps)
        root = np.sqrt(self.square / (1 - self.second**self.steps)) + 1e-8
        return flat * (1 - rate * self.decay) - rate * unbiased / root


def fit(batches: DataFrame, net: Net, epochs: int = 1, rate: float = 5e-3, l1: float = 1e-4, decay: float = 0.01, settings: Settings | None = None) -> list[dict[str, float]]:
    """Trains ``net`` in place on ``minibatches`` and returns the mean losses of each step.

    The rate falls along half a cosine, by epochs. The first layer's parameters pay ``l1`` times the rate for their absolute values.
    """
    settings, optimiser, history = settings or Settings(), AdamW(decay), []
    steps = sorted(r["step"] for r in batches.select("step").distinct().collect())
    first = net.encoder[0].weight.size + net.encoder[0].bias.size
    for epoch in range(epochs):
        now = rate * (1 + np.cos(np.pi * epoch / epochs)) / 2
        for step in steps:
            whole = _step(batches.where(F.col("step") == step), net, settings, epoch)
            if not len(whole):
                continue
            flat = net.parameters()
            gradient = whole[len(NUMBERS) : len(NUMBERS) + len(flat)].copy()
            gradient[:first] += l1 * now * np.sign(flat[:first])
            net.with_parameters(optimiser.moved(flat, gradient, now))
            net.moved(whole[len(NUMBERS) + len(flat) :])
            history.append({"epoch": epoch, "step": step, "rate": float(now)} | dict(zip(NUMBERS, whole.tolist(), strict=False)))
    return history


def traced(batches: DataFrame, net: Net, settings: Settings | None = None) -> DataFrame:
    """``(batch, loss, anchor_label, positive_label, negative_label, anchor_study, ...)``: the triplets that the net's present state gives each mini-batch, for ``training.write_trace``."""
    encoder, options = net.frozen()[0], settings or Settings()
    shared = batches.sparkSession.sparkContext.broadcast((encoder, options))
    names = [f"{side}_{c}" for c in ("label", "study") for side in SIDES]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, options = shared.value
        for part in parts:
            for i in range(len(part)):
                rows = part.column(1)[i].values
                x, ids, code, apart, study = _inputs(rows, held.n_genes)
                z = held.forward(x)
                found = mined(_squared(z), z, ids, code, apart, study, options.margin, options.mode, options.seed)
                at = [pa.array([t[k] for t in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[i].as_py()] * len(found), pa.int64()), pa.array([t[3] for t in found], pa.float64()), *(rows.field(c).take(k) for c in ("label", "study") for k in at)], ["batch", "loss", *names])

    return batches.select(F.col("batch").cast("long").alias("batch"), "rows").mapInArrow(work, "batch long, loss double, " + ", ".join(f"{n} string" for n in names))
