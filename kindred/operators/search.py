"""Searches: neighbours with their metadata, by rows, by radius, by centroids, and how coherent a query is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.neighbours import nearest, within
from kindred.sources.shared import settled

Embed = Callable[[DataFrame], DataFrame]


class Index(Protocol):
    """What a search can be routed by, in place of comparing all rows. Not every index can tell all rows within a distance."""

    def nearest(self, queries: DataFrame, k: int = 50) -> DataFrame: ...

    def within(self, queries: DataFrame, max_dist: float, among: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame: ...


def _named(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits that have their ``metadata``, in the order and with the names of a search's result."""
    return hits.select("id", "query_id", "rank", F.col("dist").alias("query_nn_dist"), *(f"`{c}`" for c in metadata.columns if c != "id"))


def search_nearest(queries: DataFrame, reference: DataFrame, metadata: DataFrame, k: int = 10_000, max_dist: float | None = None, index: Index | None = None) -> DataFrame:
    """Hits of each query joined to ``metadata`` (id, ...): the k nearest, or all within ``max_dist``; by an ``index`` of the reference if given."""
    if max_dist is None:
        hits = (nearest(queries, reference, k) if index is None else index.nearest(queries, k)).join(metadata, "id")
    else:
        hits = within(queries, reference, max_dist, metadata) if index is None else index.within(queries, max_dist, metadata=metadata)
    return _named(hits, metadata)


def search_exhaustive(queries: DataFrame, reference: DataFrame, metadata: DataFrame, max_dist: float = 0.03, equal: dict[str, object] | None = None, index: Index | None = None) -> DataFrame:
    """All hits within ``max_dist`` among the rows whose metadata equal those given; the filter comes before any distance. Exact with an ``index`` too."""
    if equal:
        metadata = metadata.where(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in equal.items())))
        reference = reference.join(metadata.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    hits = within(queries, reference, max_dist, metadata) if index is None else index.within(queries, max_dist, metadata.select("id") if equal else None, metadata)
    return _named(hits, metadata)


def mean_vectors(vectors: DataFrame, *groups: str) -> DataFrame:
    """``(*groups, vector)``: the mean of each component."""
    parts = vectors.select(*groups, F.posexplode(F.col("vector").cast("array<double>")).alias("_i", "_x"))
    means = parts.groupBy(*groups, "_i").agg(F.avg("_x").alias("_x"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(*groups).agg(ordered.alias("_v")).select(*groups, F.col("_v._x").alias("vector"))


def search_centroids(centroids: DataFrame, embed: Embed, reference: DataFrame, metadata: DataFrame, k: int = 10_000, max_dist: float | None = None, equal: dict[str, object] | None = None, index: Index | None = None) -> DataFrame:
    """Hits of each cluster's centroid: ``centroids`` (cluster, gene_idx, x) are embedded to (query_id, cluster, vector) and searched, exactly within ``max_dist`` if given."""
    # a row a cluster; without this the centroids would be computed once for the search and again for the names
    queries = settled(embed(centroids))
    names = queries.select("query_id", F.col("cluster").alias("centroid"))
    asked = queries.select("query_id", "vector")
    hits = search_nearest(asked, reference, metadata, k, index=index) if max_dist is None else search_exhaustive(asked, reference, metadata, max_dist, equal, index)
    return hits.join(names, "query_id")


def coherence(queries: DataFrame, hits: DataFrame, reference: DataFrame, clusters: int = 10, top: int = 100, seed: int = 4) -> float:
    """The mean over k-means clusters of ``queries`` (query_id, vector) of how many of the ``top`` neighbours of their centres are among ``hits`` (id)."""
    features = queries.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, seed=seed).fit(features)
    spark = queries.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "query_id long, vector array<double>")
    near = nearest(centres, reference, top)
    shared = near.join(hits.select("id").distinct(), "id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return float(centres.select("query_id").join(shared, "query_id", "left").agg(F.avg(F.coalesce("n", F.lit(0)))).first()[0])


