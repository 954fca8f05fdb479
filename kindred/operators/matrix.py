"""Sparse count matrices as DataFrames.

Long form: ``(cell_id, gene_idx, value)`` or, with symbols, ``(cell_id, symbol, value)``; coordinates that repeat are
summed. Packed form: ``(cell_id, idx array<int>, val array<float>)``, indices ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.tables import append, replace


def collapsed(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums coordinates that repeat.

    Rows are dealt by the first key, before anything is summed: few coordinates repeat, so a table of sums in each reading task would hold all its rows and save nothing. What follows
    by cell (totals, packing, joins) finds the rows in their places. All shuffle partitions are kept, as merged ones would be sized by compressed bytes, which are a fraction of what sums take.
    """
    keys = keys or ("cell_id", "gene_idx")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.select(*keys, "value").repartition(parts, keys[0]).groupBy(*keys).agg(F.sum(F.col("value").cast("double")).alias("value"))


def pack(counts: DataFrame) -> DataFrame:
    """Long to packed; one row per cell."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("gene_idx").cast("int").alias("i"), F.col("value").cast("float").alias("v"))))
    return collapsed(counts).groupBy("cell_id").agg(pairs.alias("_p")).select("cell_id", F.col("_p.i").alias("idx"), F.col("_p.v").alias("val"))


def unpack(packed: DataFrame) -> DataFrame:
    """Packed to long."""
    return packed.select("cell_id", F.explode(F.arrays_zip("idx", "val")).alias("_z")).select("cell_id", F.col("_z.idx").alias("gene_idx"), F.col("_z.val").cast("double").alias("value"))


def lognorm(counts: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """``log(1 + target_sum * value / total of the cell)`` in column ``x``; cells of total 0 stay 0; NaN counts as 0."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(0.0))
    total = F.sum(value).over(Window.partitionBy("cell_id"))
    return counts.withColumn("x", F.when(total > 0, F.log1p(F.lit(target_sum) * value / total)).otherwise(F.lit(0.0)))


def check_counts(counts: DataFrame) -> DataFrame:
    """``counts``, failing at run time on a negative value."""
    return counts.withColumn("value", F.when(F.col("value") < 0, F.raise_error(F.lit("negative values in counts"))).otherwise(F.col("value")))


def align(counts: DataFrame, target: DataFrame, least_overlap: int = 0) -> DataFrame:
    """``(cell_id, gene_idx, value)`` in the order of ``target`` (gene_idx, symbol); other symbols go, absent ones are implicit zeros.

    ``counts``: (cell_id, symbol, value). Raises ValueError if fewer than ``least_overlap`` target symbols occur.
    """
    if least_overlap:
        overlap = target.select("symbol").join(counts.select("symbol").distinct(), "symbol", "left_semi").count()
        if overlap < least_overlap:
            raise ValueError(f"only {overlap} of the target genes occur; {least_overlap} are needed")
    return collapsed(check_counts(counts).join(target.select("symbol", "gene_idx"), "symbol"))


def consolidate(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """``(cell_id, symbol, value)``: genes that share a symbol are summed. ``genes``: (gene_idx, symbol)."""
    return collapsed(counts.join(genes.select("gene_idx", "symbol"), "gene_idx"), "cell_id", "symbol")


def to_symbols(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(cell_id, symbol, value)``: ids become symbols, symbols stay, quotes are stripped, the rest goes.

    ``counts``: (cell_id, name, value), and perhaps (symbol), whose values take the names' place if no name is known; ``mapping``: (id, symbol).
    """
    pairs = mapping.select(F.col("id").alias("_id"), F.col("symbol").alias("_symbol")).union(mapping.select("symbol", "symbol")).where("_id is not null and _symbol is not null").distinct()
    plain = counts.withColumn("_id", F.translate("name", "'\"", ""))
    if "symbol" in counts.columns:
        if not plain.join(pairs, "_id", "left_semi").take(1):
            plain = plain.withColumn("_id", F.translate("symbol", "'\"", ""))
        plain = plain.drop("symbol")
    return collapsed(plain.join(pairs, "_id").withColumnRenamed("_symbol", "symbol"), "cell_id", "symbol")


def write_packed(packed: DataFrame, path: str) -> int:
    """Appends packed rows, whose cells count from 0, to the long matrix at ``path``; returns by how much cells were moved."""
    return append(unpack(packed), path, "cell_id")


def sliced(counts: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Rows of a long matrix (cell_id, gene_idx, value) of some cells (cell_id), some genes (gene_idx), or both. Either axis is a semi-join, and a filter of the scan where the list is short."""
    out = counts if cells is None else counts.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return out if genes is None else out.join(genes.select("gene_idx").distinct(), "gene_idx", "left_semi").select(*counts.columns)


def dense_row(counts: DataFrame, cell: int, width: int) -> DataFrame:
    """``(cell_id, row)``: one cell of a long matrix as a dense array of ``width`` values; raises at run time if a gene lies beyond. A cell without values has zeros."""
    own = collapsed(counts.where(F.col("cell_id") == cell)).select("gene_idx", "value")
    own = own.withColumn("value", F.when((F.col("gene_idx") >= 0) & (F.col("gene_idx") < width), F.col("value")).otherwise(F.raise_error(F.lit(f"a gene lies beyond {width}")).cast("double")))
    entries = own.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct(F.col("gene_idx").cast("int"), "value"))), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    return entries.select(F.lit(cell).cast("long").alias("cell_id"), F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("row"))


def append_matrix(counts: DataFrame, path: str, width: int, axis: str = "cell_id") -> int:
    """Appends a long matrix whose ``axis`` counts from 0 behind that at ``path``; returns by how much. Raises ValueError if its other axis reaches beyond ``width``."""
    other = "gene_idx" if axis == "cell_id" else "cell_id"
    last = counts.agg(F.max(other)).first()[0]
    if last is not None and last >= width:
        raise ValueError(f"{other} reaches {last}, but the matrix is {width} wide")
    return append(counts, path, axis)


def overwrite_matrix(counts: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """Puts a long matrix in the place of that at ``path``, which ``counts`` may read. Raises ValueError if an entry lies outside ``shape``, cells by genes; then, and if a task fails, the old one stays."""
    ends = counts.agg(*(f(c).alias(f"{n}_{c}") for c in ("cell_id", "gene_idx") for n, f in (("least", F.min), ("most", F.max)))).first()
    for c, n in zip(("cell_id", "gene_idx"), shape, strict=True):
        if ends[f"most_{c}"] is not None and not 0 <= ends[f"least_{c}"] <= ends[f"most_{c}"] < n:
            raise ValueError(f"{c} reaches from {ends[f'least_{c}']} to {ends[f'most_{c}']}, but the matrix has {n}")
    replace(counts, path)


def hits_json(hits: str) -> Column:
    """A map as JSON text, its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(hits))))
