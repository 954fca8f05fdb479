"""Centroids and pseudobulk of long counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.matrix import collapsed


def cluster_centroids(counts: DataFrame, clusters: DataFrame, label: str | None = None, skip_null: bool = True) -> DataFrame:
    """``(cluster, gene_idx, x)``: log(1 + 1e4 * sum of the gene / sum of all) of each cluster, a ratio of sums.

    ``clusters``: (cell_id, cluster). A NaN among the counts is an error at run time. ``label``: only that cluster. Cells without a cluster go, or form the cluster "nan".
    """
    named = clusters.select("cell_id", F.col("cluster").cast("string").alias("cluster"))
    named = named.where("cluster is not null") if skip_null else named.fillna("nan", ["cluster"])
    if label is not None:
        named = named.where(F.col("cluster") == label)
    checked = counts.withColumn("value", F.when(F.isnan(F.col("value").cast("double")), F.raise_error(F.lit("NaN in counts")).cast("double")).otherwise(F.col("value").cast("double")))
    sums = checked.join(named, "cell_id").groupBy("cluster", "gene_idx").agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy("cluster"))
    return sums.select("cluster", "gene_idx", F.when(total > 0, F.log1p(1e4 * F.col("value") / total)).otherwise(0.0).alias("x"))


def centroid(counts: DataFrame) -> DataFrame:
    """``(gene_idx, x)``: the centroid of all cells."""
    sums = counts.groupBy("gene_idx").agg(F.sum("value").alias("value"))
    total = sums.agg(F.sum("value").alias("_total"))
    return sums.join(F.broadcast(total)).select("gene_idx", F.when(F.col("_total") > 0, F.log1p(1e4 * F.col("value") / F.col("_total"))).otherwise(0.0).alias("x"))


def pseudobulk(counts: DataFrame, cells: DataFrame, groups: list[str], min_num_cells: int = 1, measured: DataFrame | None = None) -> DataFrame:
    """``(*groups, gene, sum, count_nonzero, cells)`` of groups of at least ``min_num_cells`` cells.

    ``counts``: (cell_id, gene, value); ``cells``: (cell_id, *groups), rows with a null group go. ``measured``: (gene); the sums of other genes become null.
    """
    known = cells.select("cell_id", *groups).dropna(subset=groups)
    sizes = known.groupBy(*groups).agg(F.count("*").alias("cells")).where(F.col("cells") >= min_num_cells)
    sums = collapsed(counts, "cell_id", "gene").join(known, "cell_id").groupBy(*groups, "gene").agg(F.sum("value").alias("sum"), F.count_if(F.col("value") != 0).alias("count_nonzero"))
    out = sums.join(sizes, groups)
    if measured is not None:
        out = out.join(measured.select("gene").distinct().withColumn("_m", F.lit(True)), "gene", "left")
        out = out.withColumns({c: F.when(F.col("_m"), F.col(c)) for c in ("sum", "count_nonzero")}).drop("_m")
    return out.select(*groups, "gene", "sum", "count_nonzero", "cells")
