"""What a user calls first: whole ways from raw counts to labels, hits and training metadata, each one plan of the other modules' parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import aggregate, encoder, learning, search, training
from kindred.operators.annotate import allowed, annotate, annotated_rows
from kindred.operators.matrix import align, consolidate, lognorm, pack
from kindred.sources.shared import settled
from kindred.sources.tables import with_row_ids


def gather_counts(ids: DataFrame, counts: DataFrame, genes: DataFrame, target: DataFrame, normalised: bool = True, target_sum: float = 1e4) -> DataFrame:
    """``(pos, cell_id, gene_idx, value)`` of the cells in ``ids`` (pos, cell_id), in the caller's order and as often as asked, projected to ``target`` (gene_idx, symbol).

    ``counts``: (cell_id, gene_idx, value); ``genes``: (gene_idx, symbol). With ``normalised`` values are log-normalised, by totals taken after the projection.
    """
    own = counts.join(ids.select("cell_id").distinct(), "cell_id", "left_semi")
    placed = align(consolidate(own, genes), target)
    if normalised:
        placed = lognorm(placed, target_sum).select("cell_id", "gene_idx", F.col("x").alias("value"))
    return ids.select("pos", "cell_id").join(placed, "cell_id").select("pos", "cell_id", "gene_idx", "value")


def embedded(counts: DataFrame, target: DataFrame, net: encoder.Encoder, least_overlap: int = 0, kind: str = "float") -> DataFrame:
    """``(cell_id, vector)`` of raw counts (cell_id, symbol, value): aligned, log-normalised, packed and embedded."""
    normal = lognorm(align(counts, target, least_overlap)).select("cell_id", "gene_idx", F.col("x").alias("value"))
    return encoder.embed(pack(normal), net, kind=kind)


def annotate_counts(counts: DataFrame, target: DataFrame, net: encoder.Encoder, reference: DataFrame, k: int = 50, weighting: bool = False, least_overlap: int = 0, kind: str = "float", index: search.Index | None = None, safelist: list[str] | None = None, blocklist: list[str] | None = None) -> DataFrame:
    """``(cell_id, vector, hint, min_dist, hits, hits_weighted, hint_stat, hint_weighted_stat)`` of every cell of raw counts that has a gene of the target.

    ``reference``: (id, vector, label), embedded by the same net, with an ``index`` of it or without. ``hint`` is the label voted for; the stats are the largest share of hits, and of weight.
    """
    vectors = embedded(counts, target, net, least_overlap, kind)
    # a cell is one row, so a reference that every task can hold labels it in its place; else its hits are dealt by cell
    out = annotated_rows(vectors, allowed(reference, safelist, blocklist), k, weighting) if index is None else None
    if out is None:
        voted = annotate(vectors.select(F.col("cell_id").alias("query_id"), "vector"), reference, k, weighting, index=index, safelist=safelist, blocklist=blocklist)
        out = vectors.join(voted, F.col("cell_id") == F.col("query_id"), "left")
    return out.select("cell_id", "vector", F.col("prediction").alias("hint"), "min_dist", "hits", "hits_weighted", F.col("vs_all").alias("hint_stat"), F.col("weighted_vs_all").alias("hint_weighted_stat"))


def embedded_centroids(counts: DataFrame, clusters: DataFrame, net: encoder.Encoder, label: str | None = None, skip_null: bool = True, kind: str = "float") -> DataFrame:
    """``(query_id, cluster, vector)`` of the centroid of each cluster of cells (cell_id, cluster); ``counts``: (cell_id, gene_idx, value) in the net's order of genes."""
    centres = aggregate.cluster_centroids(counts, clusters, label, skip_null)
    named = with_row_ids(centres.select("cluster").distinct(), "cluster", name="cell_id")
    rows = centres.join(named, "cluster").select("cell_id", "gene_idx", F.col("x").alias("value"))
    return encoder.embed_long(rows, net, kind).join(named, "cell_id").select(F.col("cell_id").alias("query_id"), "cluster", "vector")


def search_cluster_centroids(counts: DataFrame, clusters: DataFrame, net: encoder.Encoder, reference: DataFrame, metadata: DataFrame, k: int = 10_000, max_dist: float | None = None, equal: dict[str, object] | None = None, label: str | None = None, skip_null: bool = True, kind: str = "float", index: search.Index | None = None) -> DataFrame:
    """Hits of the embedded centroid of each cluster, with ``centroid``, its name: the k nearest, or all within ``max_dist`` among rows whose metadata equal those given; by an ``index`` of the reference if given."""
    queries = embedded_centroids(counts, clusters, net, label, skip_null, kind)
    return search.search_centroids(queries, lambda rows: rows, reference, metadata, k, max_dist, equal, index)


def search_centroid(counts: DataFrame, cells: DataFrame, net: encoder.Encoder, reference: DataFrame, metadata: DataFrame, k: int = 10_000, max_dist: float | None = None, equal: dict[str, object] | None = None, clusters: int | None = 10, seed: int = 4, kind: str = "float", index: search.Index | None = None) -> tuple[DataFrame, float | None]:
    """Hits of the embedded centroid of ``cells`` (cell_id), and how coherent the cells are as a query: the mean share of hits near the ``clusters`` k-means centres of their embeddings, or None without ``clusters``."""
    chosen = cells.select("cell_id", F.lit("all").alias("cluster")).dropDuplicates(["cell_id"])
    hits = search_cluster_centroids(counts, chosen, net, reference, metadata, k, max_dist, equal, kind=kind, index=index).drop("centroid")
    if clusters is None:
        return hits, None
    own = lognorm(counts.join(chosen.select("cell_id"), "cell_id", "left_semi")).select("cell_id", "gene_idx", F.col("x").alias("value"))
    vectors = encoder.embed(pack(own), net, kind=kind).select(F.col("cell_id").alias("query_id"), "vector")
    near = search.search_nearest(search.mean_vectors(vectors.withColumn("one", F.lit(0)), "one").select(F.lit(0).cast("long").alias("query_id"), "vector"), reference, metadata.select("id"), k, index=index) if max_dist is not None else hits
    return hits, search.coherence(vectors, near, reference, clusters, seed=seed)


def trained(cells: DataFrame, counts: DataFrame, target: DataFrame, net: learning.Net, path: str, size: int = 1000, batches: int = 100, epochs: int = 1, workers: int = 1, rate: float = 5e-3, decay: float | None = None, seed: int = 0, settings: learning.Settings | None = None, related: DataFrame | None = None) -> list[dict[str, float]]:
    """Trains ``net`` in place and returns its losses step by step: cells (cell_id, label, study) are drawn into ``batches`` of ``size`` by the weights of their labels and studies, their raw counts (cell_id, symbol, value)
    aligned to ``target`` (gene_idx, symbol) and log-normalised, and written as mini-batches to ``path``, of which every epoch takes all.

    With ``decay`` cells that were drawn are drawn less. ``related`` (a, b): labels that aren't negatives for each other.
    """
    drawn = settled(training.weighted_batches(training.sampler_weights(cells.select("cell_id", "label", "study")), "cell_id", size, batches, seed, decay).select("batch", "cell_id", "label", "study"))
    once = drawn.select("cell_id", "label", "study").distinct()
    packed = training.collated(once, counts, target, training.encoded_labels(cells)).select("cell_id", "idx", "val")
    rows = drawn.join(packed, "cell_id")
    return learning.fit(learning.minibatches(rows, path, workers, related), net, epochs, rate, settings=settings)


def search_metadata(cells: DataFrame, train: DataFrame, val: DataFrame, predictions: DataFrame) -> DataFrame:
    """``cells`` as the metadata of a search: with ``index`` from 0 in the order of study, sample and cell, ``data_type`` (train, test or NA), and the ``prediction`` and ``prediction_nn_dist`` of those that have one (cell_id, prediction, min_dist)."""
    tagged = training.split_tags(cells, train, val)
    voted = predictions.select("cell_id", "prediction", F.col("min_dist").alias("prediction_nn_dist"))
    return with_row_ids(tagged.join(voted, "cell_id", "left"), ["study", "sample", "cell_id"], name="index")
