"""Summaries of hits and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.quantiles import quantiles
from kindred.sources.tables import with_row_ids


def sample_rollup(hits: DataFrame, metadata: DataFrame, levels: list[str]) -> DataFrame:
    """``(query_id, *levels, cells, total, fraction)``: hits of each query by levels, and their share of all cells of the study and sample.

    Rows with a null level go. Total and fraction come only if ``study`` and ``sample`` are levels.
    """
    counted = hits.dropna(subset=levels).groupBy("query_id", *levels).agg(F.count("*").alias("cells"))
    if not {"study", "sample"} <= set(levels):
        return counted
    totals = metadata.dropna(subset=["study", "sample"]).groupBy("study", "sample").agg(F.count("*").alias("total"))
    return counted.join(totals, ["study", "sample"]).withColumn("fraction", F.col("cells") / F.col("total"))


def first_index(metadata: DataFrame, groups: tuple[str, ...] = ("study", "sample", "data_type")) -> DataFrame:
    """``(*groups, first)``: the least id of each group."""
    return metadata.groupBy(*groups).agg(F.min("cell_id").alias("first"))


def cell_index(metadata: DataFrame, groups: tuple[str, ...] = ("study", "sample", "data_type")) -> DataFrame:
    """``metadata`` with ``cell_index``: the id less the least id of its group."""
    least = first_index(metadata, groups).withColumnRenamed("first", "_first")
    return metadata.join(least, list(groups)).withColumn("cell_index", F.col("cell_id") - F.col("_first")).drop("_first")


def subset_by_unique_values(df: DataFrame, groups: list[str], value: str, n: int) -> DataFrame:
    """Rows of groups with at least ``n`` distinct values that aren't null."""
    good = df.groupBy(*groups).agg(F.count_distinct(value).alias("_n")).where(F.col("_n") >= n).select(*groups)
    return df.join(good, groups, "left_semi")


def subset_by_frequency(df: DataFrame, groups: list[str], n: int) -> DataFrame:
    """Rows of groups of at least ``n`` rows, group columns first; rows with a null group go."""
    good = df.dropna(subset=groups).groupBy(*groups).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*groups)
    return df.join(good, groups, "left_semi").select(*groups, *(c for c in df.columns if c not in groups))


def rank_by_score(df: DataFrame, name: str, score: str, ascending: bool = False, topn: int | None = None) -> DataFrame:
    """``df`` with ``name_rank``, from 1 for the lowest mean score; of ``topn`` names, chosen by the direction asked for, only those rows."""
    means = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.avg(score).alias("_mean"))
    if topn is not None:
        means = means.orderBy(F.col("_mean").asc() if ascending else F.col("_mean").desc(), name).limit(topn)
    ranks = with_row_ids(means, ["_mean", name], first=1, name="name_rank").select(name, F.col("name_rank").cast("int").alias("name_rank"))
    return df.join(F.broadcast(ranks) if topn is not None and topn <= 10_000 else ranks, name)


def proportions(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, percent)`` of the values that aren't null."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select(column, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def nested_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """``(*levels, n)``: rows at every prefix of the levels; deeper levels are null."""
    return df.dropna(subset=levels).rollup(*levels).agg(F.count("*").alias("n"), F.grouping(levels[0]).alias("_all")).where("_all = 0").drop("_all")


def leaf_sizes(df: DataFrame, levels: list[str], name: str, size: str) -> DataFrame:
    return df.groupBy(*levels, name).agg(F.sum(size).alias("size"))


def tree(leaves: DataFrame, levels: list[str], name: str) -> DataFrame:
    """``(levels[0], children)``: each level's children as an ordered array of structs, from leaves (*levels, name, size)."""
    out = leaves.withColumn("node", F.struct(F.col(name).alias("name"), "size"))
    for depth in range(len(levels), 0, -1):
        children = F.sort_array(F.collect_list("node")).alias("children")
        out = out.groupBy(*levels[:depth]).agg(children)
        if depth > 1:
            out = out.withColumn("node", F.struct(F.col(levels[depth - 1]).alias("name"), "children"))
    return out


def heatmap(df: DataFrame, row: str, column: str, values: list[object], measure: str, mean: bool = False) -> DataFrame:
    """Sum (or mean) of ``measure`` by row and, across, the given values of ``column``; 0 where there is none."""
    agg = F.avg(measure) if mean else F.sum(measure)
    return df.groupBy(row).pivot(column, values).agg(agg).na.fill(0)


def group_quantiles(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """``(group, quantile)`` by exact linear interpolation."""
    return quantiles(df, value, q, group)


def above_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Rows at or above the quantile of all rows."""
    cut = quantiles(df, value, q).select(F.col("quantile").alias("_cut"))
    return df.join(F.broadcast(cut)).where(F.col(value) >= F.col("_cut")).drop("_cut")  # one row


def score_genes(counts: DataFrame, signature: DataFrame, bins: int = 25, control: int = 50, seed: int = 0) -> DataFrame:
    """``(cell_id, score)``: the mean of the signature's genes less that of control genes of similar mean.

    ``counts``: (cell_id, gene_idx, x), zeros left out; ``signature``: (gene_idx), of which genes that occur nowhere don't count. Genes are ranked by their mean over all
    cells and cut into ``bins``; the controls are the ``control`` genes of least hash of each bin that holds a gene of the signature, the
    signature's own left out. Cells without any of these genes score 0.
    """
    cells = counts.select("cell_id").distinct()
    means = counts.groupBy("gene_idx").agg(F.sum("x").alias("_sum"))
    ranked = with_row_ids(means, ["_sum", "gene_idx"], name="_rank").join(F.broadcast(means.agg(F.count("*").alias("_all"))))
    binned = ranked.select("gene_idx", F.floor(F.col("_rank") * bins / F.col("_all")).cast("int").alias("_bin"))
    wanted = signature.select("gene_idx").distinct().withColumn("_own", F.lit(True))
    marked = binned.join(wanted, "gene_idx", "left")
    order = Window.partitionBy("_bin").orderBy(F.xxhash64("gene_idx", F.lit(seed)), "gene_idx")
    chosen = marked.where("_own is null").join(marked.where("_own").select("_bin").distinct(), "_bin", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= control)
    genes = marked.where("_own").select("gene_idx", F.lit(1).alias("_side")).union(chosen.select("gene_idx", F.lit(0)))
    sides = genes.agg(F.sum("_side").alias("_a"), F.sum(1 - F.col("_side")).alias("_b"))
    sums = counts.join(genes, "gene_idx").groupBy("cell_id").agg(F.sum(F.col("x") * F.col("_side")).alias("_x"), F.sum(F.col("x") * (1 - F.col("_side"))).alias("_y"))
    score = F.coalesce(F.try_divide("_x", "_a"), F.lit(0.0)) - F.coalesce(F.try_divide("_y", "_b"), F.lit(0.0))
    return cells.join(sums, "cell_id", "left").join(F.broadcast(sides)).select("cell_id", score.alias("score"))


def relabelled(leaves: DataFrame, levels: list[str], name: str, suffix: str, colours: DataFrame | None = None, otherwise: str = "lightgray") -> DataFrame:
    """Leaves with names that are one of a kind in a drawing: ``name`` and the last level's name with ``suffix`` between, and ``colour`` by ``colours`` (name, colour)."""
    out = leaves.withColumn("_old", F.col(name)).withColumn(name, F.concat_ws(suffix, F.col(name), F.col(levels[-1])))
    if colours is None:
        return out.drop("_old")
    named = colours.select(F.col("name").alias("_old"), F.col("colour").alias("_colour")).dropDuplicates(["_old"])
    return out.join(named, "_old", "left").withColumn("colour", F.coalesce("_colour", F.lit(otherwise))).drop("_old", "_colour")
