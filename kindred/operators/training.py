"""Relational work around training: support filters, weights, sampling, splits, triplets and silhouettes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.matrix import align, lognorm, pack
from kindred.operators.neighbours import distance_sums
from kindred.operators.quantiles import quantiles
from kindred.sources.shared import settled
from kindred.sources.tables import with_row_ids

SIDES = ("anchor", "positive", "negative")


def free(columns: list[str], name: str) -> str:
    """``name``, or as many underscores before it as it takes to clash with no column."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def label_support(df: DataFrame) -> DataFrame:
    """``(label, studies)``: distinct studies of each label."""
    return df.where("label is not null").groupBy("label").agg(F.count_distinct("study").alias("studies"))


def chosen_samples(samples: DataFrame, by: str) -> DataFrame:
    """Of each study the row with the largest ``by``."""
    rest = [c for c in samples.columns if c != "study"]
    best = samples.where("study is not null").groupBy("study").agg(F.max_by(F.struct(*rest), by).alias("_s"))
    return best.select(*(F.col("study") if c == "study" else F.col(f"_s.{c}").alias(c) for c in samples.columns))


def listed_genes(samples: DataFrame, column: str = "genes", sep: str = ",") -> DataFrame:
    """``(study, symbol)`` of samples whose genes stand in a list of text."""
    names = F.explode(F.split(F.col(column), sep, -1)).alias("symbol")
    return samples.select("study", names).withColumn("symbol", F.trim("symbol")).where("symbol <> ''")


def gene_studies(rows: DataFrame, least: int = 1) -> DataFrame:
    """``(symbol, studies)``: in how many studies each gene of rows (study, symbol) is, of those in at least ``least``."""
    return rows.where("symbol is not null").groupBy("symbol").agg(F.count_distinct("study").alias("studies")).where(F.col("studies") >= least)


def with_support(df: DataFrame, n_studies: int = 2) -> DataFrame:
    """Rows of labels in at least ``n_studies`` studies."""
    return df.join(label_support(df).where(F.col("studies") >= n_studies), "label", "left_semi")


def coarse_grained(df: DataFrame, viable: DataFrame, n_studies: int = 2) -> DataFrame:
    """Labels of less support become their most viable parent (node, parent), or null; then labels without support go."""
    weak = label_support(df).where(F.col("studies") < n_studies).join(viable.select(F.col("node").alias("label"), "parent"), "label", "left").select("label", "parent", F.lit(True).alias("_weak"))
    return with_support(df.join(weak, "label", "left").withColumn("label", F.when(F.col("_weak"), F.col("parent")).otherwise(F.col("label"))).drop("parent", "_weak"), n_studies)


def sampler_weights(df: DataFrame, class_scale: float = 1e4, study_scale: float = 1e6, cap: float | None = 0.999, use_study: bool = True) -> DataFrame:
    """``df`` with ``weight``: 1 / log1p(n_class / class_scale) / log1p(n_study / study_scale), at most twice its ``cap`` quantile; without studies 1 / n_class.

    A weight depends on label and study alone: weights, and their quantile, are computed of the counts of these, once, and joined to the rows.
    """
    pairs = df.groupBy("label", "study").agg(F.count("*").alias("_n")) if use_study else df.groupBy("label").agg(F.count("*").alias("_n_class"))
    if not use_study:
        found = pairs.select(F.col("label").alias("_label"), (1.0 / F.col("_n_class")).alias("weight"))
        return df.join(found, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    pairs = settled(pairs)
    by_label, by_study = (pairs.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("_n").alias(f"_n_{c}")) for c in ("label", "study"))
    found = pairs.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").join(by_study, F.col("study").eqNullSafe(F.col("_study"))).drop("_study")
    found = found.withColumn("weight", 1.0 / F.log1p(F.col("_n_label") / class_scale) / F.log1p(F.col("_n_study") / study_scale)).select(F.col("label").alias("_label"), F.col("study").alias("_study"), "_n", "weight")
    if cap is not None:
        limit = quantiles(found, "weight", cap, times="_n").select((2 * F.col("quantile")).alias("_cap"))  # one row
        found = found.join(F.broadcast(limit)).withColumn("weight", F.least("weight", "_cap")).drop("_cap")
    found = found.drop("_n")
    return df.join(found, F.col("label").eqNullSafe(F.col("_label")) & F.col("study").eqNullSafe(F.col("_study"))).drop("_label", "_study")


def uniform(key: Column, seed: int | Column) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: the first 52 bits of their hash."""
    text = F.concat_ws(":", key.cast("string"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, with chances by ``weight``: those of the largest log(u) / weight."""
    return df.where(F.col("weight") > 0).orderBy((F.log(uniform(F.col(key), seed)) / F.col("weight")).desc(), key).limit(n)


def weighted_batches(df: DataFrame, key: str, size: int, batches: int, seed: int = 0, decay: float | None = None, floor: float = 0.01) -> DataFrame:
    """``batches`` samples of ``size`` rows with column ``batch``; a row may be in several. With ``decay`` a chosen row's weight falls by it, to ``floor`` at least; a weight below stays.

    One plan for any number of batches. Each row arrives in each batch at an exponential time by its weight, and a batch takes the first. Weights only fall, so in batch b only rows that were
    chosen before can come later than they would have: the rows that it takes are among the first (b + 1) * size by their first weights. That is all that one task settles, batch after batch:
    its size depends on the number and size of the batches alone. Rows that come far too late for a batch, by the sum of the weights, aren't sorted for it.
    """
    names = [free(df.columns, c) for c in ("_arrival", "_place", "_sum", "_top")]
    arrival, place, total, top = names
    rows = df.where(F.col("weight") > 0)
    every = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    every = every.withColumn(arrival, -F.log(uniform(F.col(key), F.lit(seed) + F.col("batch"))) / F.col("weight"))
    # by this time twice the rows that are needed, and ten deviations more, have come on average, unless it is so late that heavy ones are sure to have come: then nothing is left out
    needed = F.lit(float(size)) * (F.lit(1) if decay is None else F.col("batch") + 1)
    until = 2 * (needed + 10 * F.sqrt(needed) + 100) / F.col(total)
    sums = rows.agg(F.sum("weight").alias(total), F.max("weight").alias(top))  # one row
    every = every.join(F.broadcast(sums)).where((F.col(arrival) <= until) | (F.col(top) * until > 1))
    first = every.withColumn(place, F.row_number().over(Window.partitionBy("batch").orderBy(arrival, key)))
    if decay is None:
        return first.where(F.col(place) <= size).drop(*names)
    among = first.where(F.col(place) <= size * batches).where(F.col(place) <= size * (F.col("batch") + 1))
    kind = df.schema[key].dataType.simpleString()

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("batch", "ascending"), ("place", "ascending")])
        batch, times, first_weight = (rows[c].to_numpy() for c in ("batch", "arrival", "weight"))
        keys, now = rows["key"].to_pylist(), {}
        taken = []
        for at, end in zip(np.searchsorted(batch, range(batches)), np.searchsorted(batch, range(batches), "right"), strict=True):
            weight = np.array([now.get(k, w) for k, w in zip(keys[at:end], first_weight[at:end], strict=True)])
            # places follow arrivals and keys, so equal times stay in the order of keys
            chosen = np.argsort(times[at:end] * first_weight[at:end] / weight, kind="stable")[:size]
            for i in chosen.tolist():
                now[keys[at + i]] = min(weight[i], max(weight[i] * decay, floor))
            taken.append(at + chosen)
        taken = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        return pa.table({"batch": rows["batch"].take(taken), "key": rows["key"].take(taken)})

    packed = among.select("batch", F.col(place).alias("place"), F.col(arrival).alias("arrival"), F.col("weight").cast("double").alias("weight"), F.col(key).alias("key"))
    chosen = packed.groupBy().applyInArrow(settle, f"batch int, key {kind}")
    return among.join(chosen.select("batch", F.col("key").alias(key)), ["batch", key], "left_semi").drop(*names).select(*df.columns, "batch")


def sampled_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, all with equal chances: those of the least seeded hash of their key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def split(df: DataFrame, val_studies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows, and validation rows (of the studies in ``val_studies`` (study)) whose labels also occur in training."""
    studies = val_studies.select("study").distinct()
    train = df.join(studies, "study", "left_anti").select(*df.columns)
    val = df.join(studies, "study", "left_semi").select(*df.columns)
    return train, val.join(train.select("label").distinct(), "label", "left_semi").select(*df.columns)


def named_labels(df: DataFrame, terms: DataFrame, column: str = "label") -> DataFrame:
    """``df`` with the ids in ``column`` replaced by the names of ``terms`` (term_id, name); rows with another id, and then rows with a null anywhere, go."""
    names = terms.select(F.col("term_id").alias("_id"), F.col("name").alias("_name")).dropDuplicates(["_id"])
    named = df.join(names, F.col(column) == F.col("_id")).withColumn(column, F.col("_name")).drop("_id", "_name")
    return named.select(*df.columns).na.drop("any")


def valid_labels(df: DataFrame, terms: DataFrame, column: str = "label") -> DataFrame:
    """Rows whose label is the name of a term; raises ValueError if none is."""
    names = terms.where("name is not null").select(F.col("name").alias(column)).distinct()
    kept = df.join(names, column, "left_semi").select(*df.columns)
    if not kept.take(1):
        raise ValueError(f"no value of {column} is the name of a term")
    return kept


def perturbed(df: DataFrame, edges: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with some labels made coarser: ``share * n`` draws with replacement, each of which gives its row a parent (parent, child) that is a label of ``df``, if there is one.

    The parent is chosen by a seeded hash; a row drawn more than once changes once. Draws are numbers below n, met with consecutive row
    numbers in the order of ``key``.
    """
    rows = with_row_ids(df.withColumn("_key", F.col(key)), "_key", name="_at")
    n = df.count()
    drawn = df.sparkSession.range(int(share * n)).select(F.floor(uniform(F.col("id"), seed) * max(n, 1)).cast("long").alias("_at")).distinct()
    present = df.select("label").distinct()
    parents = edges.select(F.col("child").alias("label"), "parent").distinct().join(present.select(F.col("label").alias("parent")), "parent", "left_semi")
    hit = rows.join(drawn, "_at", "left_semi").select("_at", "_key", "label").join(parents, "label")
    chosen = hit.groupBy("_at").agg(F.min_by("parent", F.struct(F.md5(F.concat_ws(":", "_key", "parent", F.lit(seed))), "parent")).alias("_parent"))
    return rows.join(chosen, "_at", "left").withColumn("label", F.coalesce("_parent", "label")).select(*df.columns)


def collated(cells: DataFrame, counts: DataFrame, target: DataFrame, labels: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """``(cell_id, idx, val, label_int, study)``: the rows of a mini-batch, packed, aligned to ``target`` (gene_idx, symbol) and log-normalised after that.

    ``cells``: (cell_id, label, study); ``counts``: (cell_id, symbol, value); ``labels``: (label, label_int). Rows of other labels go; a cell without a gene of the target is empty.
    """
    asked = cells.join(labels, "label").select("cell_id", "label_int", "study")
    own = counts.join(asked.select("cell_id").distinct(), "cell_id", "left_semi")
    packed = pack(lognorm(align(own, target), target_sum).select("cell_id", "gene_idx", F.col("x").alias("value")))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return asked.join(packed, "cell_id", "left").select("cell_id", empty("idx", "int").alias("idx"), empty("val", "float").alias("val"), "label_int", "study")


def mixed_loss(triplet: float, mse: float, weight: float = 0.5) -> float:
    """The loss of an encoder that is also to reconstruct its input: ``weight`` of the triplets', the rest of the reconstruction's."""
    return weight * triplet + (1 - weight) * mse


def mixed_metric(widths: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(asw, nmse, metric)``: the mean silhouette width, the mean squared error over the mean square, and (1 - asw) / 2 + nmse, least for the best.

    ``widths``: (width); ``rebuilt``: (x, y), what was and what was made of it, or sums (error, square) of the squares of their differences and of x.
    """
    asw = widths.agg(F.avg("width").alias("asw"))
    sums = F.sum("error") / F.sum("square") if "error" in rebuilt.columns else F.avg((F.col("x") - F.col("y")) ** 2) / F.avg(F.col("x") ** 2)
    error = rebuilt.agg(sums.alias("nmse"))
    return asw.join(F.broadcast(error)).withColumn("metric", (1 - F.col("asw")) / 2 + F.col("nmse"))  # one row each


def encoded_labels(df: DataFrame) -> DataFrame:
    """``(label, label_int)``: places from 0 in the order of the labels."""
    names = df.where("label is not null").select("label").distinct()
    return with_row_ids(names, "label", name="label_int").select("label", F.col("label_int").cast("int").alias("label_int"))


def split_tags(cells: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """``cells`` with ``data_type``: train, test (of validation) or NA."""
    t, v = (x.select("cell_id").distinct().withColumn(c, F.lit(True)) for x, c in ((train, "_t"), (val, "_v")))
    return cells.join(t, "cell_id", "left").join(v, "cell_id", "left").withColumn("data_type", F.when(F.col("_t"), "train").when(F.col("_v"), "test").otherwise("NA")).drop("_t", "_v")


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.array(rows["vector"].to_pylist(), dtype=np.float64).reshape(len(rows), -1)


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, by their inner products."""
    length = (x * x).sum(1)
    return np.maximum(length[:, None] + length[None, :] - 2 * (x @ x.T), 0)


def pair_distances(batch: DataFrame) -> DataFrame:
    """``(batch, a, b, dist2)``: squared distances of pairs a < b of one mini-batch. Mini-batches (batch, id, vector) have a bounded number of rows, all of one length."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, dist = rows["id"].to_numpy(), _squared(_matrix(rows))
        a, b = np.nonzero(ids[:, None] < ids[None, :])
        return pa.table({"batch": rows["batch"].take(a), "a": ids[a], "b": ids[b], "dist2": dist[a, b]})

    kind = batch.schema["batch"].dataType.simpleString()
    return batch.where("vector is not null").select("batch", F.col("id").cast("long").alias("id"), "vector").groupBy("batch").applyInArrow(work, f"batch {kind}, a long, b long, dist2 double")


def _least(dist: np.ndarray, x: np.ndarray, anchor: int, among: np.ndarray) -> int:
    """Of the rows ``among`` the nearest to the anchor, of equally near ones the first: what inner products can't tell apart is compared directly."""
    near = among[dist[among] <= dist[among].min() + 1e-9]
    return int(near[0] if len(near) == 1 else near[((x[near] - x[anchor]) ** 2).sum(1).argmin()])


def labels_apart(names: pa.Array, close: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the labels of a mini-batch, and which of them are neither equal nor ``close`` (for each row the labels that its own is related to)."""
    coded = names.dictionary_encode()
    code, place = coded.indices.to_numpy(), {name: i for i, name in enumerate(coded.dictionary.to_pylist())}
    apart = ~np.eye(len(place), dtype=bool)
    for i, others in zip(code, close, strict=True):
        apart[i, [place[o] for o in others or () if o in place]] = False
    return code, apart


def mined(dist: np.ndarray, x: np.ndarray, ids: np.ndarray, code: np.ndarray, apart: np.ndarray, study: np.ndarray, margin: float, mode: str, seed: int) -> list[tuple[int, int, int, float]]:
    """``(anchor, positive, negative, loss)`` by their places in a mini-batch sorted by id, of squared distances ``dist``; those of positive loss."""
    found: list[tuple[int, int, int, float]] = []
    for a in range(len(ids)):
        positives = np.flatnonzero((code == code[a]) & (study != study[a]) & (ids > ids[a]))
        negatives = np.flatnonzero(apart[code[a]][code])
        if not len(positives) or not len(negatives):
            continue
        if mode == "hard":
            n = _least(dist[a], x, a, negatives)
            found += [(a, p, n, dist[a, p] - dist[a, n] + margin) for p in positives]
            continue
        for p in positives:
            loss = dist[a, p] - dist[a, negatives] + margin
            good = negatives[(loss > 0) & ((loss < margin) | (mode != "semihard"))]
            if len(good):
                mixed = (ids[good] * 0x9E3779B1 + ids[a] * 0x85EBCA77 + ids[p] * 0xC2B2AE3D + seed) % 0xFFFFFFFB
                n = int(good[mixed.argmin()]) if mode == "random" else _least(dist[a], x, a, good)
                found.append((a, p, n, dist[a, p] - dist[a, n] + margin))
    return [f for f in found if f[3] > 0]


def with_close_labels(rows: DataFrame, related: DataFrame | None) -> DataFrame:
    """``rows`` (label, ...) with ``_close``: the labels that each one's is ``related`` (a, b) to, either way."""
    if related is None:
        return rows.withColumn("_close", F.array().cast("array<string>"))
    close = related.select("a", "b").union(related.select("b", "a")).distinct().groupBy(F.col("a").alias("label")).agg(F.collect_set(F.col("b").cast("string")).alias("_close"))
    return rows.join(close, "label", "left")


def triplets(batch: DataFrame, margin: float = 0.05, mode: str = "hard", related: DataFrame | None = None, seed: int = 0, trace: bool = False) -> DataFrame:
    """``(batch, anchor, positive, negative, loss)`` of each mini-batch (batch, id, label, study, vector) of bounded size.

    Anchor and positive share a label, not a study; a negative has a label that is neither theirs nor ``related`` (a, b) to it.
    ``loss`` is d(anchor, positive) - d(anchor, negative) + margin of squared distances. ``hard``: the negative of the largest loss, if it is
    positive; ``semihard``: of those below the margin; ``random``: one with positive loss by a seeded hash. Ties go to the smaller id. With ``trace`` also the labels and
    studies of the three, to be written as a record of training.

    A mini-batch is one group: a matrix of its distances and masks over it, so only triplets leave the task.
    """
    rows = with_close_labels(batch.where("vector is not null and label is not null"), related)
    rows = rows.select("batch", F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("_name"), "label", "study", "vector", "_close")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, x = rows["id"].to_numpy(), _matrix(rows)
        dist = _squared(x)
        code, apart = labels_apart(rows["_name"].combine_chunks(), rows["_close"].to_pylist())
        study = rows["study"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        found = mined(dist, x, ids, code, apart, study, margin, mode, seed)
        at = [np.array([f[k] for f in found], np.int64) for k in range(3)]
        out = {"batch": rows["batch"].take(at[0]), **{side: ids[k] for side, k in zip(SIDES, at, strict=True)}, "loss": pa.array([f[3] for f in found], pa.float64())}
        if trace:
            out |= {f"{side}_{c}": rows[c].take(k) for c in ("label", "study") for side, k in zip(SIDES, at, strict=True)}
        return pa.table(out)

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("batch", "label", "study")}
    schema = f"batch {kind['batch']}, anchor long, positive long, negative long, loss double"
    if trace:
        schema += "".join(f", {side}_{c} {kind[c]}" for c in ("label", "study") for side in SIDES)
    return rows.groupBy("batch").applyInArrow(work, schema)


def write_trace(traced: DataFrame, path: str, step: int) -> None:
    """Adds the triplets of a step, traced, to a record of training: quoted CSV, compressed, a folder a step."""
    columns = [c for c in traced.columns if c.rsplit("_", 1)[0] in SIDES]
    traced.select(*columns).write.mode("overwrite").option("compression", "gzip").option("quoteAll", True).option("header", True).csv(f"{path}/step={step}")


def silhouette(sums: DataFrame, descendants: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """``(id, label, intra, inter, width)`` from distance sums (id, label, other, total, n) of each row to the other rows of each label.

    Own label and descendants (node, related) are intra, ancestors count as neither. ``intra`` divides by one less than the number of other rows;
    ``inter`` is the least mean over labels of more than one row. Rows without both are left out.
    """
    own = F.col("label") == F.col("other")
    if descendants is not None:
        tie = descendants.select(F.col("node").alias("label"), F.col("related").alias("other")).distinct().withColumn("_d", F.lit(True))
        sums = sums.join(tie, ["label", "other"], "left")
        own = own | F.coalesce("_d", F.lit(False))
    if ancestors is not None:
        sums = sums.join(ancestors.select(F.col("node").alias("label"), F.col("related").alias("other")).distinct(), ["label", "other"], "left_anti")
    means = sums.groupBy("id", "label").agg(
        F.sum(F.when(own, F.col("total"))).alias("_in"),
        F.sum(F.when(own, F.col("n"))).alias("_n"),
        F.min(F.when(~own & (F.col("n") > 1), F.col("total") / F.col("n"))).alias("inter"),
    )
    out = means.where("_n > 1 and inter is not null").withColumn("intra", F.col("_in") / (F.col("_n") - 1))
    return out.select("id", "label", "intra", "inter", ((F.col("inter") - F.col("intra")) / F.greatest("intra", "inter")).alias("width"))


def average_width(rows: DataFrame, squared: bool = True, descendants: DataFrame | None = None, ancestors: DataFrame | None = None) -> float | None:
    """The mean silhouette width of rows (id, label, vector) by squared Euclidean distances, or cosine ones; None where no row has one."""
    return silhouette(distance_sums(rows, squared), descendants, ancestors).agg(F.avg("width")).first()[0]


def ranked_genes(attributions: DataFrame, top: int | None = None) -> DataFrame:
    """``(gene_idx, attribution, std, cells, half_width)``: mean, population deviation and 1.96 standard errors over cells, largest mean first; only the ``top`` of them if given."""
    stats = attributions.groupBy("gene_idx").agg(F.avg("value").alias("attribution"), F.stddev_pop("value").alias("std"), F.count("*").alias("cells"))
    out = stats.withColumn("half_width", 1.96 * F.col("std") / F.sqrt("cells")).orderBy(F.desc("attribution"), "gene_idx")
    return out if top is None else out.limit(top)
