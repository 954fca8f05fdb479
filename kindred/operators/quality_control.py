"""Measures of cells and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qc_metrics(counts: DataFrame, is_mito: Column) -> DataFrame:
    """``(cell_id, total_counts, n_genes, total_mt, pct_mt)`` of long counts; ``is_mito`` marks their rows."""
    totals = counts.groupBy("cell_id").agg(
        F.sum("value").alias("total_counts"),
        F.count_if(F.col("value") != 0).alias("n_genes"),
        F.sum(F.when(is_mito, F.col("value")).otherwise(0.0)).alias("total_mt"),
    )
    return totals.withColumn("pct_mt", F.when(F.col("total_counts") != 0, 100 * F.col("total_mt") / F.col("total_counts")).otherwise(0.0))


def mito_prefix(genes: DataFrame) -> str:
    """``mt-`` if any symbol starts so, else ``MT-``."""
    return "mt-" if genes.where(F.col("symbol").startswith("mt-")).take(1) else "MT-"


def filter_cells(metrics: DataFrame, min_genes: int = 400, mito_percent: float = 30.0) -> DataFrame:
    """Cells of less than ``mito_percent`` (strict) and at least ``min_genes`` genes."""
    return metrics.where((F.col("pct_mt") < mito_percent) & (F.col("n_genes") >= min_genes))


def qc_pass(metrics: DataFrame, mito_percent: float = 100.0, min_counts: float = 0, min_genes: int = 0, max_nn_dist: float = 0.03) -> DataFrame:
    """The filter before pseudobulk: ``mito_percent`` inclusive; ``nn_dist`` counts wherever the column exists."""
    kept = metrics.where((F.col("pct_mt") <= mito_percent) & (F.col("total_counts") >= min_counts) & (F.col("n_genes") >= min_genes))
    return kept.where(F.col("nn_dist") <= max_nn_dist) if "nn_dist" in metrics.columns else kept


def exclude(df: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among ``excluded``; rows with a null key stay."""
    return df.join(F.broadcast(excluded.select(*keys).distinct()) if excluded.isLocal() else excluded.select(*keys).distinct(), list(keys), "left_anti")


def differs(column: str, value: object) -> Column:
    """Null-safe ``!=``: keeps nulls."""
    return ~F.col(column).eqNullSafe(F.lit(value))
