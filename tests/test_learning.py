"""The training loop: gradients by finite differences, what a step sums, that it learns; the way back; batches in one plan."""

from __future__ import annotations

import gzip
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import encoder, flows, learning, training


def small_batch(n=12, genes=9, seed=0):
    rng = np.random.default_rng(seed)
    x = np.maximum(rng.normal(size=(n, genes)), 0)
    code, study = np.arange(n) % 3, np.arange(n) // 3 % 2
    return x, np.arange(n), code, ~np.eye(3, dtype=bool), study


@pytest.mark.parametrize("weight", [0.0, 0.4, 1.0])
def test_gradients_equal_finite_differences(weight):
    net, batch = learning.Net.random(9, [7, 6], 4, seed=3), small_batch()
    settings = learning.Settings(margin=0.3, mode="hard", triplet_weight=weight, input_dropout=0.3, dropout=0.2)
    rng = lambda: np.random.default_rng(5)
    y, _ = learning._forward(net.encoder, batch[0], [0.3, 0.2, 0.0], rng())
    z = y / np.linalg.norm(y, axis=1, keepdims=True)
    # which triplets there are is no part of the gradient
    fixed = training.mined(training._squared(z), z, *batch[1:], 0.3, "hard", 0)
    assert len(fixed) > 3
    _, gradient, _ = net.losses(*batch, settings, rng(), fixed)
    flat = net.parameters()
    assert len(gradient) == len(flat)
    for i in np.random.default_rng(1).choice(len(flat), 60, replace=False):
        values = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[i] += step
            net.with_parameters(moved)
            values.append(net.losses(*batch, settings, rng(), fixed)[0]["loss"])
        assert gradient[i] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3, abs=1e-6), i


def test_adamw_equals_a_plain_form():
    rng, optimiser = np.random.default_rng(0), learning.AdamW(decay=0.1)
    flat = rng.normal(size=5)
    p, m, v = flat.copy(), np.zeros(5), np.zeros(5)
    for t in range(1, 6):
        g = rng.normal(size=5)
        flat = optimiser.moved(flat, g, 0.01)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - 0.01 * 0.1) - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(flat, p)


GENES = 40


def rows(spark, n=480, seed=0):
    """Cells whose label shifts a few genes, and whose study shifts others; in mini-batches of 60."""
    rng = np.random.default_rng(seed)
    label, study = rng.integers(0, 4, n), rng.integers(0, 3, n)
    mean = np.full((n, GENES), 0.4)
    mean[np.arange(n)[:, None], (label * 4)[:, None] + np.arange(4)] += 1.2
    mean[np.arange(n)[:, None], 20 + (study * 5)[:, None] + np.arange(5)] += 2.5
    x = np.log1p(rng.poisson(mean))
    data = [(int(i // 60), int(i), f"L{label[i]}", f"S{study[i]}", np.flatnonzero(x[i]).tolist(), x[i][x[i] > 0].tolist()) for i in range(n)]
    return spark.createDataFrame(data, "batch long, cell_id long, label string, study string, idx array<int>, val array<float>")


def test_it_learns(spark, tmp_path):
    batches = learning.minibatches(rows(spark), str(tmp_path / "batches"), workers=2)
    assert batches.count() == 8 and {r["step"] for r in batches.select("step").distinct().collect()} == {0, 1, 2, 3}
    net = learning.Net.random(GENES, [16], 8, seed=1)
    before = net.frozen()
    history = learning.fit(batches, net, epochs=6, rate=0.02, settings=learning.Settings(margin=0.2, input_dropout=0.1, dropout=0.1))
    assert len(history) == 24 and history[0]["rate"] > history[-1]["rate"]
    first, last = (np.mean([h["loss"] for h in part]) for part in (history[:4], history[-4:]))
    assert last < 0.7 * first
    held = rows(spark, 300, seed=9)
    widths, errors = [], []
    for there, back in (before, net.frozen()):
        vectors = encoder.embed(held, there, kind="double").join(held.select("cell_id", "label"), "cell_id").select(F.col("cell_id").alias("id"), "label", "vector")
        widths.append(training.average_width(vectors))
        errors.append(encoder.reconstruction(held, there, back).agg(F.sum("error") / F.sum("square")).first()[0])
    assert widths[1] > widths[0] + 0.05 and errors[1] < errors[0]
    # the record of what the last state mines
    traced = learning.traced(batches.where("step = 0"), net, learning.Settings(margin=0.2, mode="hard"))
    assert traced.where("anchor_label <> positive_label or anchor_label = negative_label or anchor_study = positive_study").count() == 0 and traced.count() > 0
    training.write_trace(traced, str(tmp_path / "trace"), 7)
    lines = [line for f in Path(tmp_path / "trace/step=7").glob("*.csv.gz") for line in gzip.open(f, "rt").read().splitlines()]
    assert lines[0].startswith('"anchor_label","positive_label"') and sum('"L' in x for x in lines) == traced.count()


def test_training_from_raw_counts(spark, tmp_path):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i, f"L{i % 3}", f"S{i % 2}") for i in range(90)] + [(90, None, "S0")], "cell_id long, label string, study string")
    counts = spark.createDataFrame([(i, f"g{g}", float(1 + rng.poisson(6 if g % 3 == i % 3 else 1))) for i in range(91) for g in range(12)] + [(0, "unknown", 9.0)], "cell_id long, symbol string, value double")
    target = spark.createDataFrame([(g, f"g{g}") for g in range(12)], "gene_idx int, symbol string")
    net = learning.Net.random(12, [8], 4, seed=1)
    history = flows.trained(cells, counts, target, net, str(tmp_path / "b"), size=40, batches=4, epochs=5, workers=2, rate=0.03, decay=0.5, settings=learning.Settings(margin=0.2, input_dropout=0.0, dropout=0.0))
    assert len(history) == 10 and np.mean([h["loss"] for h in history[-2:]]) < 0.8 * history[0]["loss"]
    held = spark.read.parquet(str(tmp_path / "b"))
    sizes = {r.batch: len(r.rows) for r in held.collect()}
    assert set(sizes) == {0, 1, 2, 3} and all(38 <= n <= 40 for n in sizes.values())
    there, _ = net.frozen()
    vectors = flows.embedded(counts, target, there, kind="double").join(cells.where("label is not null"), "cell_id").select(F.col("cell_id").alias("id"), "label", "vector")
    assert training.average_width(vectors) > 0.3


def test_a_step_doesnt_depend_on_its_tasks(spark, tmp_path):
    related = spark.createDataFrame([("L0", "L1")], "a string, b string")
    one = learning.minibatches(rows(spark, 180), str(tmp_path / "one"), workers=3, related=related)
    net, settings = learning.Net.random(GENES, [8], 4), learning.Settings(mode="hard", margin=0.3)
    sums = learning._step(one, net, settings, 2)
    assert np.allclose(sums, learning._step(one.coalesce(1), net, settings, 2)) and np.array_equal(sums, learning._step(one, net, settings, 2))
    assert not np.allclose(sums, learning._step(one, net, settings, 3))
    assert learning.traced(one, net, settings).where("(anchor_label = 'L0' and negative_label = 'L1') or (anchor_label = 'L1' and negative_label = 'L0')").count() == 0
    # the sum over mini-batches, by hand
    whole = np.zeros(len(net.parameters()))
    for r in one.toArrow().to_pylist():
        struct = pa.array(r["rows"], one.select("rows").limit(1).toArrow()["rows"].type.value_type)
        whole += net.losses(*learning._inputs(struct, GENES), settings, np.random.default_rng([0, 2, r["batch"]]))[1]
    assert np.allclose(sums[4 : 4 + len(whole)], whole / 3)


def test_no_rows_and_nulls(spark, tmp_path):
    none = learning.minibatches(rows(spark, 5).where("false"), str(tmp_path / "none"))
    net = learning.Net.random(GENES, [8], 4)
    assert learning.fit(none, net) == []
    odd = rows(spark, 6).withColumn("label", F.when(F.col("cell_id") > 2, F.col("label"))).withColumn("study", F.lit(None).cast("string"))
    few = learning.minibatches(odd, str(tmp_path / "few"))
    (h,) = learning.fit(few, net)
    assert h["triplets"] == 0 and np.isfinite(h["loss"]) and few.select(F.explode("rows")).count() == 3


def test_the_way_back(spark):
    rng = np.random.default_rng(2)
    net = learning.Net.random(6, [5], 3, seed=2)
    for b in net.blocks():
        if b.mean is not None:
            b.mean, b.variance = rng.normal(size=len(b.mean)), rng.uniform(0.5, 2, len(b.mean))
    there, back = net.frozen()
    z = rng.normal(size=(4, 3))
    x = z
    for b in net.decoder:
        x = x @ b.weight.T + b.bias
        if b.gamma is not None:
            x = (x - b.mean) / np.sqrt(b.variance + 1e-5) * b.gamma + b.beta
            x = np.where(x >= 0, x, 0.25 * x)
    vectors = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(z)), (9, None), (10, [1.0])], "cell_id long, vector array<double>")
    got = {r.cell_id: r["values"] for r in encoder.decode(vectors, back, kind="double").collect()}
    assert set(got) == {0, 1, 2, 3} and np.allclose([got[i] for i in range(4)], x)
    packed = spark.createDataFrame([(1, [0, 4], [1.0, 2.0]), (2, [], [])], "cell_id long, idx array<int>, val array<float>")
    dense = np.array([[1, 0, 0, 0, 2, 0], np.zeros(6)])
    want = ((dense - back.forward(there.forward(dense))) ** 2).sum(1)
    found = {r.cell_id: r for r in encoder.reconstruction(packed, there, back).collect()}
    assert np.allclose([found[1].error, found[2].error], want) and found[1].square == 5 and found[2].square == 0


def sampled_by_hand(weights, size, batches, seed, decay, floor):
    import hashlib

    now, out = dict(weights), []
    for b in range(batches):
        u = {k: (int(hashlib.md5(f"{k}:{seed + b}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in now}
        chosen = sorted((k for k in now if now[k] > 0), key=lambda k: (-np.log(u[k]) / now[k], k))[:size]
        out += [(b, k) for k in chosen]
        if decay is not None:
            now |= {k: min(now[k], max(now[k] * decay, floor)) for k in chosen}
    return set(out)


@pytest.mark.parametrize("decay", [None, 0.5, 0.01])
def test_batches_are_those_of_one_after_another(spark, decay):
    weights = {i: float(w) for i, w in enumerate(np.random.default_rng(3).exponential(size=150))} | {200: 0.0, 201: 0.005}
    df = spark.createDataFrame([(k, w, "x") for k, w in weights.items()], "id long, weight double, _arrival string")
    got = training.weighted_batches(df, "id", 20, 12, seed=4, decay=decay)
    assert got.columns == ["id", "weight", "_arrival", "batch"]
    assert {(r.batch, r.id) for r in got.collect()} == sampled_by_hand(weights, 20, 12, 4, decay, 0.01)


def test_the_plan_of_batches_doesnt_grow(spark):
    df = spark.range(60_000).select("id", F.lit(1.0).alias("weight"))
    lines = [len(training.weighted_batches(df, "id", 50, n, decay=0.5)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (2, 100)]
    assert lines[1] <= lines[0]
    assert training.weighted_batches(df, "id", 50, 40, decay=0.5).groupBy("batch").count().where("count = 50").count() == 40
    weights = {i: 1.0 for i in range(60_000)}
    assert {(r.batch, r.id) for r in training.weighted_batches(df, "id", 50, 4, seed=6, decay=0.5).collect()} == sampled_by_hand(weights, 50, 4, 6, 0.5, 0.01)
