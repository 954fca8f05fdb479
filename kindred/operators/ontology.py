"""Directed acyclic term graphs: ``edges`` (parent, child), and the closure (ancestor, descendant, depth) made from it once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shared import settled


def closure(edges: DataFrame, levels: int = 100) -> DataFrame:
    """``(ancestor, descendant, depth)`` of all strict ancestors, at their least depth.

    A frontier is joined to the edges until it is empty, each pair once, so diamonds don't multiply rows. Raises
    ValueError if the graph has a cycle or is deeper than ``levels``.
    """
    known = edges.where("parent is not null and child is not null").select(F.col("parent").alias("_p"), F.col("child").alias("_c")).distinct()
    known = settled(known)
    frontier = known.select(F.col("_p").alias("ancestor"), F.col("_c").alias("descendant"), F.lit(1).alias("depth"))
    levels_found = [frontier]
    for depth in range(2, levels + 2):
        step = frontier.join(known, frontier["descendant"] == known["_p"]).select("ancestor", F.col("_c").alias("descendant"), F.lit(depth).alias("depth")).distinct()
        if step.where("ancestor = descendant").take(1):
            raise ValueError("the graph has a cycle")
        # each level is written once; what was found before is read, not written again
        found = reduce(DataFrame.union, levels_found)
        frontier = settled(step.join(found, ["ancestor", "descendant"], "left_anti"))
        if not frontier.take(1):
            return found
        levels_found.append(frontier)
    raise ValueError(f"the graph is deeper than {levels} levels, or has a cycle")


def related(lookup: DataFrame, nodes: DataFrame, given: str, wanted: str, allowed: DataFrame | None = None) -> DataFrame:
    """``(node, wanted)``: rows of ``lookup`` for each of ``nodes`` (node), among ``allowed`` (node) if given."""
    out = nodes.select("node").distinct().join(lookup.select(F.col(given).alias("node"), F.col(wanted)).distinct(), "node")
    return out if allowed is None else out.join(allowed.select(F.col("node").alias(wanted)).distinct(), wanted, "left_semi").select("node", wanted)


def children(edges: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    return related(edges, nodes, "parent", "child", allowed)


def parents(edges: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    return related(edges, nodes, "child", "parent", allowed)


def siblings(edges: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``(node, sibling)``: the children of all parents but the node; a root has none."""
    of = parents(edges, nodes)
    out = of.join(edges.select("parent", F.col("child").alias("sibling")), "parent").where("sibling <> node").select("node", "sibling").distinct()
    return out if allowed is None else out.join(allowed.select(F.col("node").alias("sibling")).distinct(), "sibling", "left_semi").select("node", "sibling")


def ancestors(pairs: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """``(node, ancestor)`` from the closure; with the node itself if ``inclusive``."""
    out = related(pairs, nodes, "descendant", "ancestor", allowed)
    return out.union(nodes.select("node", "node")).distinct() if inclusive else out


def descendants(pairs: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    out = related(pairs, nodes, "ancestor", "descendant", allowed)
    return out.union(nodes.select("node", "node")).distinct() if inclusive else out


def lineage(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, related)``: ancestors and descendants of each node, each once: the terms that can't be told apart from it as labels."""
    up = ancestors(pairs, nodes).withColumnRenamed("ancestor", "related")
    return up.union(descendants(pairs, nodes).withColumnRenamed("descendant", "related")).distinct()


def lowest_common_ancestors(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``(a, b, lca)`` for asked pairs (a, b): of their common inclusive ancestors that have no common ancestor below them the least id."""
    both = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    up = ancestors(pairs, both, inclusive=True)
    common = asked.join(up.select(F.col("node").alias("a"), F.col("ancestor").alias("c")), "a").join(up.select(F.col("node").alias("b"), F.col("ancestor").alias("c")), ["b", "c"]).select("a", "b", "c")
    above = common.join(pairs.select(F.col("descendant").alias("c"), F.col("ancestor").alias("_up")), "c").select("a", "b", F.col("_up").alias("c")).distinct()
    return common.join(above, ["a", "b", "c"], "left_anti").groupBy("a", "b").agg(F.min("c").alias("lca"))


def similarities(pairs: DataFrame, nodes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``(a, b, similarity)`` of pairs a < b with common strict ancestors: their number, but for ``excluded`` (node)."""
    up = ancestors(pairs, nodes)
    if excluded is not None:
        up = up.join(excluded.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_anti")
    left, right = up.select(F.col("node").alias("a"), "ancestor"), up.select(F.col("node").alias("b"), "ancestor")
    return left.join(right, "ancestor").where("a < b").groupBy("a", "b").agg(F.count("*").alias("similarity"))


def most_viable_parent(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(node, parent)`` of every node; null where there is none.

    The only allowed parent; of several, the least that has another of them among its ancestors; without any, where there is
    one parent and that has one allowed parent, the latter.
    """
    asked = nodes.select("node").distinct()
    every = parents(edges, asked)
    good = parents(edges, asked, allowed)
    n_every = every.groupBy("node").agg(F.count("*").alias("n_every"), F.min("parent").alias("only"))
    n_good = good.groupBy("node").agg(F.count("*").alias("n_good"), F.min("parent").alias("one"))
    other = good.select("node", F.col("parent").alias("other"))
    deep = good.join(other, "node").join(pairs.select(F.col("descendant").alias("parent"), F.col("ancestor").alias("other")), ["parent", "other"]).groupBy("node").agg(F.min("parent").alias("deep"))
    grand = parents(edges, every.select(F.col("parent").alias("node")).distinct(), allowed).groupBy(F.col("node").alias("only")).agg(F.count("*").alias("n_grand"), F.min("parent").alias("grand"))
    joined = asked.join(n_every, "node", "left").join(n_good, "node", "left").join(deep, "node", "left").join(grand, "only", "left")
    pick = F.when(F.col("n_good") == 1, F.col("one")).when(F.col("n_good") > 1, F.col("deep")).when((F.col("n_every") == 1) & (F.col("n_grand") == 1), F.col("grand"))
    return joined.select("node", pick.alias("parent"))
