"""Embedding of packed counts by a frozen network, and which features its distances hang on.

The network in evaluation mode is [Linear, BatchNorm, PReLU] for each hidden layer, a Linear layer and division by the
length. Tasks load its arrays once; a first layer that is large stays in a file, of which tasks read what they meet. Counts are sparse and genes many, so no task makes a dense matrix of genes: the first layer, and the last one of a
decoder, are multiplied with the values that rows hold. Rows that hold most genes (centroids) are taken in their long form, whose tasks add up products before anything is gathered.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.shared import new_folder, settled

BATCH = 1024
STEPS = 50
#: Numbers of a matrix that a task makes at once, and of one that the driver writes at once.
CELLS, WRITTEN = 1 << 20, 1 << 23
#: Bytes of a matrix by genes up to which every Python worker gets a copy.
COPIED = 1 << 26
ATTRIBUTED = "pair_id long, gene_idx int, value double"


@dataclass
class Layer:
    weight: np.ndarray  # (out, in)
    bias: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None  # gamma / sqrt(variance + epsilon)
    shift: np.ndarray | None = None
    slope: np.ndarray | None = None  # of PReLU


@dataclass
class Encoder:
    layers: list[Layer] = field(default_factory=list)

    @property
    def n_genes(self) -> int:
        return self.layers[0].weight.shape[1]

    @classmethod
    def random(cls, n_genes: int, hidden: list[int], latent: int, seed: int = 0) -> Encoder:
        """An untrained network of these sizes."""
        rng, sizes, layers = np.random.default_rng(seed), [n_genes, *hidden, latent], []
        for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
            layer = Layer(rng.normal(0, 1 / np.sqrt(a), (b, a)), rng.normal(0, 0.1, b))
            if k < len(hidden):
                layer.mean, layer.scale, layer.shift, layer.slope = rng.normal(0, 0.1, b), np.ones(b), np.zeros(b), np.full(b, 0.25)
            layers.append(layer)
        return cls(layers)

    def save(self, path: str) -> None:
        """As a numpy archive; layers in the order of their numbers."""
        np.savez(path, **{f"{k}.{name}": value for k, layer in enumerate(self.layers) for name, value in vars(layer).items() if value is not None})

    @classmethod
    def load(cls, path: str) -> Encoder:
        with np.load(path) as held:
            count = 1 + max(int(name.split(".")[0]) for name in held)
            return cls([Layer(**{name.split(".")[1]: held[name] for name in held if int(name.split(".")[0]) == k}) for k in range(count)])

    def write(self, spark: SparkSession, path: str) -> None:
        """As a table of arrays, in any folder that Spark can write."""
        rows = [(k, name, list(value.shape), value.astype("<f8").tobytes()) for k, layer in enumerate(self.layers) for name, value in vars(layer).items() if value is not None]
        spark.createDataFrame(rows, "layer int, name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Encoder:
        layers: dict[int, dict[str, np.ndarray]] = {}
        for r in spark.read.parquet(path).collect():
            layers.setdefault(r["layer"], {})[r["name"]] = np.frombuffer(r["data"], "<f8").reshape(r["shape"])
        return cls([Layer(**layers[k]) for k in sorted(layers)])

    def linear(self, x: np.ndarray, keep: list[np.ndarray] | None = None) -> np.ndarray:
        """Dense rows through all layers; ``keep`` gets what ``backward`` needs."""
        for layer in self.layers:
            x = x @ layer.weight.T + layer.bias
            if layer.mean is not None:
                x = (x - layer.mean) * layer.scale + layer.shift
            if layer.slope is not None:
                if keep is not None:
                    keep.append(x)
                x = np.where(x >= 0, x, layer.slope * x)
        return x

    def rest(self) -> Encoder:
        """The net that takes the first layer's products with rows, ``x @ weight.T``, in place of rows."""
        first = self.layers[0]
        return type(self)([Layer(np.eye(len(first.bias)), first.bias, first.mean, first.scale, first.shift, first.slope), *self.layers[1:]])

    def forward(self, x: np.ndarray, keep: list[np.ndarray] | None = None) -> np.ndarray:
        """Unit latent vectors of dense rows."""
        x = self.linear(x, keep)
        size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if keep is not None:
            keep.append(size)
        return x / size

    def backward(self, out: np.ndarray, keep: list[np.ndarray], gradient: np.ndarray) -> np.ndarray:
        """The gradient by the input from that by the output."""
        kept = list(keep)
        g = (gradient - out * (gradient * out).sum(1, keepdims=True)) / kept.pop()
        for layer in reversed(self.layers):
            if layer.slope is not None:
                g = g * np.where(kept.pop() >= 0, 1.0, layer.slope)
            if layer.mean is not None:
                g = g * layer.scale
            g = g @ layer.weight
        return g

    def slopes(self, anchors: np.ndarray, negatives: np.ndarray, steps: int = STEPS) -> np.ndarray:
        """The integrated gradient of the squared latent distance by the first layer's products with rows, from those of anchors and negatives. The way between two rows is straight there too, so this is all that the genes' gradients hang on."""
        nodes, weights = np.polynomial.legendre.leggauss(steps)
        rest = self.rest()
        base, total = rest.forward(negatives), np.zeros_like(anchors, dtype=np.float64)
        for at, weight in zip((nodes + 1) / 2, weights / 2, strict=True):
            keep: list[np.ndarray] = []
            out = rest.forward(negatives + at * (anchors - negatives), keep)
            total += weight * rest.backward(out, keep, 2 * (out - base))
        return total

    def attributions(self, anchors: np.ndarray, negatives: np.ndarray, steps: int = STEPS) -> np.ndarray:
        """Integrated gradients of the squared latent distance on the way from each negative to its anchor, by Gauss-Legendre quadrature; absolute, and 0 where the anchor isn't larger."""
        weight = self.layers[0].weight
        total = self.slopes(anchors @ weight.T, negatives @ weight.T, steps) @ weight
        return np.abs(total * (anchors - negatives)) * (anchors > negatives)


class Decoder(Encoder):
    """The way back: a net of the mirrored sizes, from latent vectors to genes, whose outputs are as they come."""

    @property
    def n_latent(self) -> int:
        return self.layers[0].weight.shape[1]

    def forward(self, x: np.ndarray, keep: list[np.ndarray] | None = None) -> np.ndarray:
        return self.linear(x, keep)

    def backward(self, out: np.ndarray, keep: list[np.ndarray], gradient: np.ndarray) -> np.ndarray:
        raise NotImplementedError("attributions are an encoder's")


@dataclass
class Rows:
    """Packed rows: how many values each has, and all values with their genes. A null row is empty."""

    lengths: np.ndarray
    genes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, idx: pa.ListArray, val: pa.ListArray) -> Rows:
        lengths = np.asarray(idx.value_lengths().fill_null(0), dtype=np.int64)
        genes, values = np.asarray(idx.flatten()), np.asarray(val.flatten(), dtype=np.float64)
        if len(values) != lengths.sum():
            raise ValueError("a row has more indices than values, or fewer")
        return cls(lengths, genes, values)

    def times(self, weight: np.ndarray | Columns) -> np.ndarray:
        """The product of the rows, were they dense, with a matrix of one column, and one row of the result, a gene; indices beyond the width are an error."""
        return sums(np.repeat(np.arange(len(self.lengths)), self.lengths), self.genes, self.values, weight, len(self.lengths))


class Columns:
    """A matrix (out, genes) whose columns stand in a file that Spark sends to every executor once. Tasks read the columns of the genes they meet, so none holds the matrix, however many genes there are."""

    def __init__(self, context: SparkContext, weight: np.ndarray):
        self.name, self.dtype, self.shape = f"weights-{uuid.uuid4().hex}", weight.dtype, weight.shape
        path, step = os.path.join(tempfile.mkdtemp(prefix="kindred-"), self.name), max(1, WRITTEN // max(len(weight), 1))
        with open(path, "wb") as file:
            for at in range(0, weight.shape[1], step):
                file.write(np.ascontiguousarray(weight[:, at : at + step].T))
        context.addFile(path)

    def __len__(self) -> int:
        return self.shape[0]

    def take(self, genes: np.ndarray, axis: int = 1) -> np.ndarray:
        """``(out, n)``, as an array's ``take`` along the genes; indices beyond the width are an error."""
        some, place = np.unique(genes, return_inverse=True)
        if len(some) and not 0 <= some[0] <= some[-1] < self.shape[1]:
            raise IndexError(f"genes reach from {some[0]} to {some[-1]}, but the matrix is {self.shape[1]} wide")
        size = len(self) * self.dtype.itemsize
        with open(SparkFiles.get(self.name), "rb", buffering=0) as file:
            raw = b"".join([os.pread(file.fileno(), size, gene * size) for gene in some.tolist()])
        return np.ascontiguousarray(np.frombuffer(raw, self.dtype).reshape(len(some), len(self))[place].T)


def at_hand(context: SparkContext, weight: np.ndarray) -> np.ndarray | Columns:
    """What tasks take columns from: the matrix itself if it is small."""
    return weight if weight.nbytes <= COPIED else Columns(context, weight)


def sums(row: np.ndarray, genes: np.ndarray, values: np.ndarray, weight: np.ndarray | Columns, n: int) -> np.ndarray:
    """``(n, out)``: of each row, whose values stand together, the sum of values times the columns of ``weight`` (out, genes)."""
    out, step = np.zeros((n, len(weight))), max(1, CELLS // max(len(weight), 1))
    for at in range(0, len(row), step):
        here = row[at : at + step]
        starts = np.flatnonzero(np.diff(here, prepend=-1))
        out[here[starts]] += np.add.reduceat(weight.take(genes[at : at + step], axis=1) * values[at : at + step], starts, axis=1).T
    return out


def _lists(matrix: np.ndarray, kind: str) -> pa.ListArray:
    """The rows of a matrix, as lists over one flat array."""
    values = pa.array(matrix.astype(np.float32 if kind == "float" else np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), values)


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), size):
            yield batch.slice(at, size)


def _whole(rows: Rows) -> Rows:
    if np.isnan(rows.values).any():
        raise ValueError("NaN in the rows to embed")
    return rows


def embed(packed: DataFrame, encoder: Encoder, num_cells: int | None = None, kind: str = "float") -> DataFrame:
    """``(cell_id, vector)`` of packed rows (cell_id, idx, val) that are log-normalised; at most ``num_cells`` rows by cell_id. Vectors are arrays of ``kind``.

    A NaN in a row fails the task.
    """
    context = packed.sparkSession.sparkContext
    shared = context.broadcast((encoder.rest(), at_hand(context, encoder.layers[0].weight)))
    if num_cells is not None:
        packed = packed.orderBy("cell_id").limit(num_cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, weight = shared.value
        for part in _parts(batches, BATCH):
            vectors = rest.forward(_whole(Rows.of(part.column(1), part.column(2))).times(weight))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(vectors, kind)], ["cell_id", "vector"])

    return packed.select(F.col("cell_id").cast("long").alias("cell_id"), "idx", "val").mapInArrow(run, f"cell_id long, vector array<{kind}>")


def products(counts: DataFrame, weight: np.ndarray) -> DataFrame:
    """``(cell_id, sums array<double>)`` of long rows (cell_id, gene_idx, value): their products with ``weight`` (out, genes), and last the sum of squares; values as floats, as packed ones are. Tasks add up what they read, so a cell may have any number of genes."""
    context = counts.sparkSession.sparkContext
    shared = context.broadcast(at_hand(context, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            cells, row = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            order = np.argsort(row, kind="stable")
            genes, values = (np.asarray(batch.column(k))[order] for k in (1, 2))
            if np.isnan(values).any():
                raise ValueError("NaN in the rows to embed")
            row, values = row[order], values.astype(np.float64)
            found = np.column_stack([sums(row, genes, values, weight, len(cells)), np.bincount(row, values * values, len(cells))])
            at, k = (x.ravel() for x in np.indices(found.shape))
            yield pa.RecordBatch.from_arrays([pa.array(cells[at]), pa.array(k.astype(np.int32)), pa.array(found.ravel())], ["cell_id", "k", "x"])

    rows = counts.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("gene_idx").cast("int").alias("gene_idx"), F.col("value").cast("float").alias("value"))
    added = rows.mapInArrow(run, "cell_id long, k int, x double").groupBy("cell_id", "k").agg(F.sum("x").alias("x"))
    return added.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_s")).select("cell_id", F.col("_s.x").alias("sums"))


def _flat(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def embed_long(counts: DataFrame, encoder: Encoder, kind: str = "float") -> DataFrame:
    """What ``embed`` makes of long rows (cell_id, gene_idx, value), each coordinate once, when they are packed; for cells of so many genes that none should be one row."""
    rest = encoder.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, BATCH):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(rest.forward(_flat(part.column(1))[:, :-1]), kind)], ["cell_id", "vector"])

    return products(counts, encoder.layers[0].weight).mapInArrow(run, f"cell_id long, vector array<{kind}>")


def decode(vectors: DataFrame, decoder: Decoder, kind: str = "float") -> DataFrame:
    """``(cell_id, values)`` of latent vectors (cell_id, vector), one value a gene. Null vectors, and those of another length, take no part."""
    shared = vectors.sparkSession.sparkContext.broadcast(decoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in _parts(batches, BATCH):
            x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(part), -1)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(net.forward(x), kind)], ["cell_id", "values"])

    fit = vectors.where(F.size("vector") == decoder.n_latent).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("vector").cast("array<double>").alias("vector"))
    return fit.mapInArrow(run, f"cell_id long, values array<{kind}>")


@dataclass
class Loss:
    """What is lost on the way through both nets, of rows that are known by their products with ``weight``: with the first layer, and with what the decoder's last one, which is linear, gives for a latent value and for none.

    The decoder gives z = last @ h + bias, so |x - z|^2 = |x|^2 - 2 (h . last' x + bias . x) + |z|^2, and |z|^2 hangs on h by the inner products of the last layer's columns alone: no dense row is made.
    """

    weight: np.ndarray | Columns
    there: Encoder
    back: Decoder
    inner: np.ndarray

    @classmethod
    def of(cls, encoder: Encoder, decoder: Decoder) -> Loss:
        *before, last = decoder.layers
        if last.slope is not None:
            raise ValueError("the decoder's last layer must be linear")
        matrix, bias = last.weight, last.bias
        if last.mean is not None:
            matrix, bias = matrix * last.scale[:, None], (bias - last.mean) * last.scale + last.shift
        if len(bias) != encoder.n_genes:
            raise ValueError(f"the encoder takes {encoder.n_genes} genes, the decoder gives {len(bias)}")
        small = np.int8 if all(x.dtype == np.int8 for x in (encoder.layers[0].weight, matrix)) and not bias.any() else np.float64
        weight = np.concatenate([encoder.layers[0].weight.astype(small, copy=False), matrix.T.astype(small, copy=False), bias[None, :].astype(small)])
        inner, n = 0.0, matrix.shape[1]
        for at in range(0, len(bias), max(1, CELLS // (n + 1))):
            some = slice(at, at + max(1, CELLS // (n + 1)))
            block = np.concatenate([matrix[some].astype(np.float64), bias[some, None]], axis=1)
            inner = inner + block.T @ block
        return cls(weight, encoder.rest(), Decoder(before), np.asarray(inner).reshape(n + 1, n + 1))

    def error(self, found: np.ndarray, square: np.ndarray) -> np.ndarray:
        """From the products with ``weight`` and |x|^2."""
        n = len(self.there.layers[0].bias)
        h = np.concatenate([self.back.linear(self.there.forward(found[:, :n])), np.ones((len(found), 1))], axis=1)
        return np.maximum(square - 2 * (h * found[:, n:]).sum(1) + ((h @ self.inner) * h).sum(1), 0)


ERRORS = "cell_id long, error double, square double, genes long"


def reconstruction(packed: DataFrame, encoder: Encoder, decoder: Decoder) -> DataFrame:
    """``(cell_id, error, square, genes)`` of packed rows (cell_id, idx, val): what is lost on the way through both nets, the sum of squared differences over all genes, beside the sum of squares. The decoder's last layer must be linear. No dense row is made."""
    loss, genes = Loss.of(encoder, decoder), encoder.n_genes
    context = packed.sparkSession.sparkContext
    shared = context.broadcast(replace(loss, weight=at_hand(context, loss.weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = shared.value
        for part in _parts(batches, BATCH):
            rows = _whole(Rows.of(part.column(1), part.column(2)))
            square = np.bincount(np.repeat(np.arange(len(part)), rows.lengths), rows.values**2, minlength=len(part)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(loss.error(rows.times(loss.weight), square)), pa.array(square), pa.array(np.full(len(part), genes, np.int64))], ["cell_id", "error", "square", "genes"])

    return packed.select(F.col("cell_id").cast("long").alias("cell_id"), "idx", "val").mapInArrow(run, ERRORS)


def reconstruction_long(counts: DataFrame, encoder: Encoder, decoder: Decoder) -> DataFrame:
    """What ``reconstruction`` makes of long rows (cell_id, gene_idx, value), each coordinate once, when they are packed."""
    loss, genes = Loss.of(encoder, decoder), encoder.n_genes
    rest = Loss(np.zeros((0, 0)), loss.there, loss.back, loss.inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, BATCH):
            found = _flat(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rest.error(found[:, :-1], found[:, -1])), pa.array(found[:, -1]), pa.array(np.full(len(part), genes, np.int64))], ["cell_id", "error", "square", "genes"])

    return products(counts, loss.weight).mapInArrow(run, ERRORS)


def attribute(pairs: DataFrame, encoder: Encoder, steps: int = STEPS) -> DataFrame:
    """``(pair_id, gene_idx, value)``, zeros left out, of pairs (pair_id, anchor_idx, anchor_val, negative_idx, negative_val)."""
    shared = pairs.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        weight = net.layers[0].weight
        for part in _parts(batches, 128):
            anchors, negatives = (Rows.of(part.column(k), part.column(k + 1)) for k in (1, 3))
            slopes = net.slopes(anchors.times(weight), negatives.times(weight), steps)
            ends = [np.cumsum(x.lengths) for x in (anchors, negatives)]
            for i in range(len(part)):
                # only genes of the anchor can be larger in it, or those that are below 0 in the negative
                genes = np.unique(np.concatenate([x.genes[e[i] - x.lengths[i] : e[i]] for x, e in zip((anchors, negatives), ends, strict=True)]))
                more, less = np.zeros(len(genes)), np.zeros(len(genes))
                for x, e, to in ((anchors, ends[0], more), (negatives, ends[1], less)):
                    own = slice(e[i] - x.lengths[i], e[i])
                    np.add.at(to, np.searchsorted(genes, x.genes[own]), x.values[own])
                for at in range(0, len(genes), max(1, CELLS // len(weight))):
                    some = slice(at, at + max(1, CELLS // len(weight)))
                    found = np.abs((slopes[i] @ weight[:, genes[some]]) * (more[some] - less[some])) * (more[some] > less[some])
                    kept = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.full(len(kept), i))), pa.array(genes[some][kept].astype(np.int32)), pa.array(found[kept])], ["pair_id", "gene_idx", "value"])

    columns = ["anchor_idx", "anchor_val", "negative_idx", "negative_val"]
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), *columns).mapInArrow(run, ATTRIBUTED)


def by_gene(spark: SparkSession, weight: np.ndarray) -> DataFrame:
    """``(gene_idx, weights)`` of a matrix (out, genes), as a table in the shared folder, written some genes at a time; for joins, where no task should hold all genes."""
    path, step = new_folder(spark, "weights"), max(1, WRITTEN // max(len(weight), 1))
    for at in range(0, weight.shape[1], step):
        part = np.ascontiguousarray(weight[:, at : at + step].T)
        table = pa.table({"gene_idx": pa.array(np.arange(at, at + len(part), dtype=np.int32)), "weights": _lists(part, "double")})
        spark.createDataFrame(table).write.mode("append").parquet(path)
    return spark.read.schema("gene_idx int, weights array<double>").parquet(path)


def attribute_long(pairs: DataFrame, counts: DataFrame, encoder: Encoder, steps: int = STEPS) -> DataFrame:
    """What ``attribute`` makes of pairs (pair_id, anchor, negative) of cells in long rows (cell_id, gene_idx, value), each coordinate once.

    For few cells of many genes: genes meet their weights in a join, and no row, task or group holds all of them. Pairs and their slopes, as many numbers a pair as the first layer has outputs, are collected.
    """
    spark = pairs.sparkSession
    rows = counts.select(F.col("cell_id").cast("long").alias("c"), F.col("gene_idx").cast("int").alias("gene_idx"), F.col("value").cast("float").cast("double").alias("v"))
    joined = settled(rows.groupBy("gene_idx").agg(F.collect_list("c").alias("c"), F.collect_list("v").alias("v")).join(by_gene(spark, encoder.layers[0].weight), "gene_idx"))
    asked = pairs.select("pair_id", "anchor", "negative").orderBy("pair_id").toArrow()
    cells = np.unique(np.concatenate([asked["anchor"].to_numpy(), asked["negative"].to_numpy()]))
    size = max(1, CELLS // max(len(cells), len(encoder.layers[0].bias), 1))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for part in _parts(batches, size):
            lengths = np.asarray(part.column(1).value_lengths(), dtype=np.int64)
            gene, cell = np.repeat(np.arange(len(part)), lengths), np.asarray(part.column(1).flatten())
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            known, x = cells[at] == cell, np.zeros((len(part), len(cells)))
            np.add.at(x, (gene[known], at[known]), np.asarray(part.column(2).flatten())[known])
            if np.isnan(x).any():
                raise ValueError("NaN in the rows to embed")
            yield part, x, _flat(part.column(3))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((x.T @ weights for _, x, weights in matrices(batches)), np.zeros(()))
        if total.ndim:
            at, k = (i.ravel() for i in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), pa.array(total.ravel())], ["at", "k", "x"])

    if not len(cells):
        return spark.createDataFrame([], ATTRIBUTED)
    inner = np.zeros((len(cells), len(encoder.layers[0].bias)))
    for r in joined.mapInArrow(first, "at long, k long, x double").groupBy("at", "k").agg(F.sum("x").alias("x")).toArrow().to_pylist():
        inner[r["at"], r["k"]] = r["x"]
    anchor, negative = (np.searchsorted(cells, asked[x].to_numpy()) for x in ("anchor", "negative"))
    names, slopes = asked["pair_id"].to_numpy(), encoder.slopes(inner[anchor], inner[negative], steps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, weights in matrices(batches):
            for i, name in enumerate(names):
                more = x[:, anchor[i]] - x[:, negative[i]]
                found = np.abs((weights @ slopes[i]) * more) * (more > 0)
                kept = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), name)), part.column(0).take(pa.array(kept)), pa.array(found[kept])], ["pair_id", "gene_idx", "value"])

    return joined.mapInArrow(work, ATTRIBUTED)


def save_model(path: str, net: Encoder, genes: DataFrame, labels: DataFrame, studies: DataFrame) -> None:
    """A net with what it takes to use it again: ``genes`` (gene_idx, symbol), ``labels`` (label, label_int) and ``studies`` (study, part), the lists of training and validation."""
    net.write(genes.sparkSession, f"{path}/net")
    for name, table in (("genes", genes), ("labels", labels), ("studies", studies)):
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[Encoder, DataFrame, DataFrame, DataFrame]:
    """What ``save_model`` wrote. Raises ValueError if the gene order is not as wide as the net."""
    net = Encoder.read(spark, f"{path}/net")
    genes, labels, studies = (spark.read.parquet(f"{path}/{name}") for name in ("genes", "labels", "studies"))
    if genes.count() != net.n_genes:
        raise ValueError(f"the net takes {net.n_genes} genes, the gene order has {genes.count()}")
    return net, genes, labels, studies
