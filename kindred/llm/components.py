"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a few joins and partial aggregations; the state is checkpointed to the shared
folder, so lost executors cost at most one step. Nothing is collected but two numbers a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import partitions, shared_dir

#: Links that a checkpoint's file holds, on average, before another one is made.
PER_FILE = 50_000


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """Links each neighbour of u to the least of u and its neighbours: the larger neighbours, or u and the smaller ones. Links may repeat after a large star.

    The least neighbours are written first, for then Spark splits the join where a node has very many links.
    """
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files).checkpoint()
    joined = near.join(least.hint("merge"), "u")  # not a broadcast a round, as links may be many
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that has a link to another; ``component`` is the least node it can reach.

    ``links`` may repeat, be empty, or hold nulls and self-links, which are ignored; nodes are of any type that has an order. Raises if the
    components have not settled after ``rounds`` rounds (each halves the depth of the trees).
    """
    shared_dir(links.sparkSession)
    ends = [F.col(left), F.col(right)]
    edges = links.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"), *(e.alias(f"_{i}") for i, e in enumerate(ends)))
    edges, count, before = edges.where("_0 is not null and _1 is not null and u <> v").select("u", "v").distinct(), links.count(), None
    for step in range(rounds + 1):
        # links only get fewer, so few of them need few files
        files = max(1, min(partitions(links), count // PER_FILE))
        if step:
            larger = _star(edges, True, files).coalesce(files).checkpoint()
            edges = _star(larger, False, files)
        edges = edges.coalesce(files).checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before, count = now, now[0]
    raise RuntimeError(f"components have not settled after {rounds} rounds")
