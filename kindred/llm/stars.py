"""From shared keys to groups whose pairs are to be verified.

Two nodes are candidates if they share a key (a band of a signature, a filter). Verifying key by key moves a node, and verifies a pair, as often as
keys are shared; connected components chain nodes that share nothing. Between them stand stars: each key's nodes go to the leader
of the key, the node among them that shares its keys with most others. So candidates always meet, all members of a star share a key with its
leader, and the many keys of a group of copies mostly have one leader.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import partitions, written

BLOCK = 512


def stars(rows: DataFrame) -> DataFrame:
    """``(node, leader)``, each once, from ``rows`` (key, node): two nodes with a common key have a common leader. Nodes that share no key are left out.

    Keys are counted, and their leaders chosen, by aggregates that combine before they shuffle; these are written before they are joined, as Spark splits a
    skewed join of tables, but not one that an aggregate feeds. So a key that very many nodes share is no task of its own.
    """
    many = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "many")
    shared = written(rows.join(many, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("_m")).select("key", F.col("_m.node").alias("leader"))
    return written(shared.join(written(leaders, "leaders"), "key").select("node", "leader").distinct(), "stars")


def forest(links: np.ndarray) -> np.ndarray:
    """The least index each index can reach over a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shared_before(lists: list[np.ndarray], current: int) -> np.ndarray:
    """Which pairs share a number less than ``current``."""
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ids = np.concatenate(lists)
    who, ids = who[ids < current], ids[ids < current]
    names, place = np.unique(ids, return_inverse=True)
    out = np.zeros((len(lists), len(lists)), np.float32)
    for at in range(0, len(names), 2048):
        marks = np.zeros((len(lists), min(2048, len(names) - at)), np.float32)
        here = (place >= at) & (place < at + 2048)
        marks[who[here], place[here] - at] = 1
        out += marks @ marks.T
    return out > 0


def dealt(pairs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``pairs`` (node, leader) dealt to pairs of blocks of their star: columns ``_i <= _j`` name the pair, ``_b`` the node's own block. And the number of rows.

    A star of at most ``block`` nodes has the one pair (0, 0); one of n nodes has about n/block blocks.
    """
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("_n")).withColumn("_g", F.ceil(F.col("_n") / block).cast("int"))
    rows = sizes.agg(F.coalesce(F.sum(F.col("_n") * F.col("_g")), F.lit(0))).first()[0]
    numbered = pairs.join(sizes.where("_g > 1").select("leader", "_g"), "leader", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    numbered = numbered.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_g")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda k: F.struct(F.least(k, F.col("_b")).alias("_i"), F.greatest(k, F.col("_b")).alias("_j")))
    return numbered.withColumn("_p", F.explode(blocks)).select("node", "leader", "_b", "_p._i", "_p._j"), int(rows)


def verified(pairs: DataFrame, content: DataFrame, link: Callable[[list[bytes], list[bytes] | None], np.ndarray], block: int = BLOCK) -> DataFrame:
    """``(node, partners, root)``: partial numbers of partners, by their copies, and a link to a smaller node; one forest a pair of blocks.

    ``pairs``: (node, leader); ``content``: (node, copies, raw), where one node may have several rows, told apart by ``name``, which is what comes back as
    ``node``. ``link(left, right)`` says which of the raw values link; without ``right`` among themselves. A pair that meets in several stars
    counts in the least of them. The number of groups follows that of the rows, so a group holds about two blocks at any size of the table.
    """
    placed, rows = dealt(pairs, block)
    lists = pairs.groupBy("node").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
    full = placed.join(content.join(lists, "node"), "node")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("leader", "_i", "_j", "name")])
        leader, low, high, own, copies = (rows[c].to_numpy() for c in ("leader", "_i", "_j", "_b", "copies"))
        edges = np.flatnonzero((np.diff(leader) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(leader)]]), strict=True):
            if end - at < 2:
                continue
            raw = rows["raw"].slice(at, end - at).to_pylist()
            if low[at] == high[at]:
                links = link(raw, None)
                np.fill_diagonal(links, False)
            else:
                a, b = (np.flatnonzero(own[at:end] == k) for k in (low[at], high[at]))
                links = np.zeros((end - at, end - at), bool)
                if len(a) and len(b):
                    links[np.ix_(a, b)] = link([raw[i] for i in a], [raw[i] for i in b])
                links |= links.T
            has = np.flatnonzero(links.any(1))
            if len(has):
                links = links[np.ix_(has, has)]
                first = links & ~shared_before([np.array(x, np.int64) for x in rows["leaders"].take(at + has).to_pylist()], leader[at])
                found.append((at + has, first @ copies[at:end][has], at + has[forest(links)]))
        node, partners, root = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"node": rows["name"].take(node), "partners": partners.astype(np.int64), "root": rows["name"].take(root)})

    slots = max(partitions(pairs), -(-rows // (2 * block)))
    kind = content.schema["name"].dataType.simpleString()
    slot = F.pmod(F.xxhash64("leader", "_i", "_j"), F.lit(slots))
    return full.withColumn("_s", slot).groupBy("_s").applyInArrow(work, f"node {kind}, partners long, root {kind}")
