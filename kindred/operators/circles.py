"""Circles within circles: the layout of a tree of counts, such as hits by tissue, disease and study.

Children are packed within their parent from the largest to the smallest: each touches two neighbours on the outside of those that stand already, as near to the middle as
there is room. A parent is the circle around its children; so leaves' areas follow their sizes, and a parent's whatever its children take. A task packs one parent's children.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shared import settled

#: Steps toward the middle of the circle around others, and what may be lost to rounding, as a share of the radii.
STEPS, SLACK = 2000, 1e-9


def packed(radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres of circles that don't overlap, about the middle of a circle around them all, and its radius."""
    n, order = len(radii), np.argsort(-radii, kind="stable")
    x, y, r = np.zeros(n), np.zeros(n), radii[order].astype(np.float64)
    if n > 1:
        x[:2] = -r[0], r[1]
    # neighbours on the outside, which lies to the right of the way from one to the next
    pairs = np.array([[0, 1], [1, 0]])
    for c in range(2, n):
        a, b = pairs.T
        near, far, apart = r[a] + r[c], r[b] + r[c], np.hypot(x[b] - x[a], y[b] - y[a])
        along = (near**2 - far**2 + apart**2) / (2 * apart)
        out = np.sqrt(np.maximum(near**2 - along**2, 0))
        ux, uy = (x[b] - x[a]) / apart, (y[b] - y[a]) / apart
        px, py = x[a] + along * ux + out * uy, y[a] + along * uy - out * ux
        room = np.hypot(px[:, None] - x[None, :c], py[:, None] - y[None, :c]) - (r[:c] + r[c])
        free = (room >= -SLACK * (r[:c] + r[c])).all(1)
        if free.any():
            best = int(np.where(free, px**2 + py**2, np.inf).argmin())
        else:
            # there is always room beyond the one that reaches farthest
            last = int((x[:c] + r[:c]).argmax())
            best = int((pairs[:, 0] == last).argmax())
            px[best], py[best] = x[last] + r[last] + r[c], y[last]
        x[c], y[c] = px[best], py[best]
        # where this one finds no room the smaller ones behind it are not sought room for again, while there are others
        alive = free if free.sum() > 8 else np.ones(len(pairs), bool)
        alive[best] = False
        pairs = np.concatenate([pairs[alive], [[a[best], c], [c, b[best]]]])
    middle = np.array([x.mean(), y.mean()]) if n else np.zeros(2)
    for t in range(STEPS if n > 1 else 0):
        way = np.stack([x - middle[0], y - middle[1]])
        reach = np.hypot(*way) + r
        i = int(reach.argmax())
        size = np.hypot(*way[:, i])
        middle = middle + way[:, i] * (reach[i] / size if size else 1) / (t + 2)
    whole = float((np.hypot(x - middle[0], y - middle[1]) + r).max()) if n > 1 else float(r.sum())
    if n == 1:
        middle = np.array([x[0], y[0]])
    back = np.empty((2, n))
    back[:, order] = x - middle[0], y - middle[1]
    return back[0], back[1], whole


def _children(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, node, r, dx, dy, whole)`` of nodes (*keys, node, r)."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        x, y, whole = packed(rows["r"].to_numpy())
        return rows.append_column("dx", pa.array(x)).append_column("dy", pa.array(y)).append_column("whole", pa.array(np.full(len(x), whole)))

    schema = ", ".join([*(f"`{k}` string" for k in keys), "node string, r double, dx double, dy double, whole double"])
    return settled(nodes.select(*keys, "node", "r").groupBy(*keys).applyInArrow(pack, schema))


def layout(leaves: DataFrame, levels: list[str], name: str, size: str = "size") -> DataFrame:
    """``(depth, *levels, name, x, y, r)``: a circle for each node of the tree of leaves (*levels, name, size), within a circle of radius 1 about (0, 0).

    Depth 1 are the values of the first level; leaves are one deeper than the levels; names below a node's own are null. Leaves with a null name or level, and those of no size, are
    left out. A leaf that repeats is as large as its rows together.
    """
    text = [F.col(c).cast("string").alias(c) for c in levels]
    sizes = leaves.dropna(subset=[*levels, name]).groupBy(*text, F.col(name).cast("string").alias("node")).agg(F.sum(size).alias("_size")).where("_size > 0")
    nodes, by_depth = sizes.select(*levels, "node", F.sqrt(F.col("_size").cast("double")).alias("r")), []
    for depth in range(len(levels), -1, -1):
        made = _children(nodes, levels[:depth])
        by_depth.insert(0, made)
        if depth:
            up = made.groupBy(*levels[:depth]).agg(F.max("whole").alias("r"))
            nodes = up.withColumnRenamed(levels[depth - 1], "node")
    unit = by_depth[0].agg(F.max("whole").alias("_unit"))  # one row
    out, above = None, None
    for depth, made in enumerate(by_depth):
        if above is not None:
            parent = above.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(levels[: depth - 1])), F.col("node").alias(f"_p{depth - 1}"), F.col("x").alias("_x"), F.col("y").alias("_y"))
            same = [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(levels[:depth])]
            made = made.join(parent, same).withColumn("x", F.col("_x") + F.col("dx")).withColumn("y", F.col("_y") + F.col("dy"))
        else:
            made = made.withColumn("x", F.col("dx")).withColumn("y", F.col("dy"))
        above = made.select(*levels[:depth], "node", "x", "y", "r")
        own = [*levels[:depth], "node"]
        named = [F.col(own[i]).alias(c) if i < len(own) else F.lit(None).cast("string").alias(c) for i, c in enumerate([*levels, name])]
        rows = above.select(F.lit(depth + 1).alias("depth"), *named, "x", "y", "r")
        out = rows if out is None else out.union(rows)
    scaled = {c: F.col(c) / F.col("_unit") for c in ("x", "y", "r")}
    return out.join(F.broadcast(unit)).withColumns(scaled).drop("_unit")
