"""Exact quantiles by counts of ranges of values: no task gathers a column or a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.shared import settled


def quantiles(df: DataFrame, value: str, q: float, *groups: str, times: str | None = None) -> DataFrame:
    """``(*groups, quantile)`` by linear interpolation between the two values next to rank ``q * (n - 1)``; nulls don't count, and groups of nothing else are left out.
    With ``times`` a row counts as often as that column says.

    Values are counted (so a frequent one is one row), cut into ranges of group and value, and the ranges' sizes say which of them hold the two
    ranks; only within these do rows get numbers. A large group spreads over many ranges.
    """
    keys = list(groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg((F.count("*") if times is None else F.sum(times)).alias("_n"))
    spread = settled(counts.repartitionByRange(*keys, "_value").withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), "_size", before.alias("_start"), (F.lit(q) * (F.sum("_size").over(own) - 1)).alias("_rank"))
    low, high = F.floor("_rank"), F.ceil("_rank")
    starts = starts.where((F.col("_start") <= high) & (F.col("_start") + F.col("_size") > low))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_p"))
    ends = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    placed = spread.join(starts, same).withColumn("_end", ends).withColumn("_begin", F.col("_end") - F.col("_n"))
    at = lambda rank: F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col("_value")))
    found = placed.groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high"), F.max(F.col("_rank") - low).alias("_share"))
    return found.select(*keys, ((1 - F.col("_share")) * F.col("_low") + F.col("_share") * F.col("_high")).cast("double").alias("quantile"))
