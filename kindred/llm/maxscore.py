"""Exact top-k search by MaxScore over shards of quantised vectors.

Every component, by the sign that a query gives it, is a term; its posting list holds a shard's rows from the highest contribution
down, cut into tiers, each with a bound: what the rows behind it can contribute at most. Tiers are essential from the top down until
the bounds behind them, summed over the terms, stay below the k-th best score so far. Only the postings of essential tiers are traversed and
add to a row's partial score; the other components are probed, widest first, for the rows that are still competitive.
A look at the first tier of all terms gives the threshold a start. Scores are integers, so the result is exact.

Rows are dealt to shards once; queries go to every shard and stream past its index in batches, so no task holds all queries of a shard, and gives
at most k rows a query. Shards are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import partitions, written

TOP = 5
SCALE = 256
EVERY = 50
#: Rows of a shard, on average.
SHARD = 8192
#: Where the tiers of a posting list end, as shares of its rows.
TIERS = np.array([0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1])
#: The tier that all terms are traversed to at first.
FIRST = 2
#: Components that are probed between two looks at the threshold.
PROBED = 8
#: Rows that are scored at once for the first threshold, and from which on probing isn't worth a look.
TRIED = 64


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double, as little-endian 64-bit bytes; null for null, empty and broken vectors."""

    @F.arrow_udf(returnType=T.BinaryType())
    def floors(column: pa.Array) -> pa.Array:
        lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        values = column.flatten()
        numbers = np.asarray(values.fill_null(float("nan")), dtype=np.float64)
        broken = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
        with np.errstate(invalid="ignore"):
            whole = np.floor(scale * numbers)
        ends = np.cumsum(lengths)
        return pa.array([whole[e - n : e].astype("<i8").tobytes() if n and broken[e] == broken[e - n] else None for e, n in zip(ends, lengths, strict=True)], pa.binary())

    return floors(vector)


class Shard:
    """Impact-ordered posting lists of some rows of one length, in the order of their ids. ``touched``: contributions that were added up so far, of ``full``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n = len(ids)
        self.up = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32).T
        self.sorted = np.take_along_axis(self.rows.T, self.up, axis=1).astype(np.float64)
        self.ends = np.unique(np.ceil(TIERS * n).astype(np.int64))
        self.columns = np.ascontiguousarray(self.rows.T)
        # bounds behind each tier; behind the last one nothing is left, and the least contribution is what every row has
        last = np.minimum(self.ends, n - 1)
        self.behind = {1: self.sorted[:, n - 1 - last], -1: -self.sorted[:, last]}
        self.touched = self.full = 0

    def traversed(self, query: np.ndarray, level: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """What each row's postings up to the tier ``level`` of each term contribute, over and above ``behind``."""
        n, where, what = len(self.ids), [], []
        for t in np.flatnonzero(level):
            end = self.ends[level[t]]
            part = slice(n - end, n) if query[t] > 0 else slice(0, end)
            where.append(self.up[t, part])
            what.append(self.sorted[t, part] * query[t])
            what[-1] -= behind[t]
            self.touched += end
        return np.bincount(np.concatenate(where), np.concatenate(what), minlength=n)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows but those with the query's id; of equal scores the smaller ids."""
        n, d = self.rows.shape
        others = self.ids != own
        self.full += n * d
        if others.sum() <= k or not d or not query.any():
            keep = np.flatnonzero(others)
            return self._best(keep, self.rows[keep] @ query, k)
        size = np.abs(query).astype(np.float64)
        bounds = np.where((query > 0)[:, None], self.behind[1], self.behind[-1]) * size[:, None]
        tiers = bounds.shape[1] - 1
        # a first look: what the first tiers of all terms say are good rows gives the threshold
        level = np.where(size > 0, min(FIRST, tiers), 0)
        head = self.traversed(query, level, bounds[np.arange(d), level])
        head[~others] = -1
        tried = np.argpartition(-head, min(TRIED, n - 1))[:TRIED]
        tried = tried[others[tried]]
        exact = self.rows[tried] @ query
        self.touched += d * len(tried)
        if len(tried) < k:
            return self._best(np.flatnonzero(others), self.rows[others] @ query, k)
        threshold = np.partition(exact, len(exact) - k)[len(exact) - k]
        level = self.essential(bounds, level, threshold)
        # an upper bound of each row's score: its postings, and of the terms in which it has none the bound behind the tier reached
        behind = bounds[np.arange(d), level]
        upper = self.traversed(query, level, behind) + behind.sum()
        slack = 1e-9 * (np.abs(upper).max() + size.max() * np.abs(self.sorted).max() * d) + 0.5
        rank = np.flatnonzero(others & (upper >= threshold - slack))
        upper = upper[rank]
        # probe what isn't known yet, the terms of the widest range behind their tiers first, while rows fall away
        width = behind - np.where(query > 0, self.sorted[:, 0], -self.sorted[:, -1]) * size
        order = np.argsort(-width, kind="stable")
        for at in range(0, d, PROBED):
            terms = order[at : at + PROBED]
            if len(rank) <= TRIED or width[terms[0]] <= 0:
                break
            value = self.columns[terms][:, rank] * query[terms][:, None]
            upper += np.minimum(value - behind[terms][:, None], 0).sum(0)
            self.touched += len(rank) * len(terms)
            good = upper >= threshold - slack
            rank, upper = rank[good], upper[good]
        self.touched += d * len(rank)
        return self._best(rank, self.rows[rank] @ query, k)

    def essential(self, bounds: np.ndarray, least: np.ndarray, threshold: float) -> np.ndarray:
        """For each term the tier to traverse to, ``least`` at least: those that lower the sum of bounds most for their postings, until it is below the threshold."""
        gain = np.maximum(bounds[:, :-1] - bounds[:, 1:], 0)
        gain[np.arange(gain.shape[1])[None, :] < least[:, None]] = 0
        rate = np.minimum.accumulate(np.where(np.arange(gain.shape[1])[None, :] < least[:, None], np.inf, gain / np.diff(self.ends)), axis=1)
        terms, steps = np.nonzero(np.isfinite(rate) & (rate > 0))
        order = np.lexsort((steps, -rate[terms, steps]))
        left = bounds[np.arange(len(bounds)), least].sum() - np.cumsum(gain[terms[order], steps[order]])
        taken = order[: int(np.searchsorted(-left, -threshold, side="right")) + 1]
        level = least.copy()
        np.maximum.at(level, terms[taken], steps[taken] + 1)
        return level if bounds[np.arange(len(bounds)), least].sum() >= threshold else least

    def _best(self, keep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep, score = keep[score >= cut], score[score >= cut]
        best = np.lexsort((self.ids[keep], -score))[:k]
        return self.ids[keep[best]], score[best]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches (shard, dim, asks, vec_id, raw), sorted by the first three, so that a shard's rows come before its queries."""
    current, rows, held = None, [], None
    for batch in batches:
        shard, dim, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for at, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(shard)]]), strict=True):
            if at == end:
                continue
            if current != (shard[at], dim[at]):
                current, rows, held = (shard[at], dim[at]), [], None
            ids = batch.column(3).slice(at, end - at).to_numpy()
            data = np.frombuffer(b"".join(batch.column(4).slice(at, end - at).to_pylist()), "<i8").reshape(end - at, -1)
            if not asks[at]:
                rows.append((ids, data))
                continue
            if held is None:
                if not rows:
                    continue
                held, rows = Shard(*(np.concatenate(x) for x in zip(*rows, strict=True))), []
            found = [(i, *held.top(q, i, k)) for i, q in zip(ids, data, strict=True)]
            asked = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(asked), *(pa.array(np.concatenate([x[j] for x in found]).astype(np.int64)) for j in (1, 2))], schema=FOUND)


def top_scores(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of the quantised vectors of each query with all others.

    Queries are the rows whose vec_id is divisible by ``every``; a query's own id is no candidate. Ties go to the smaller
    vec_id; with fewer candidates all are returned. Null, empty and non-finite vectors and null ids take no part; vectors
    of another length than the query's are no candidates; a repeated row is one candidate, and asks once. An id with several vectors asks with all of
    them, and its k best scores are those of all.
    """
    base = vectors.where("vec_id is not null").select("vec_id", quantised(F.col("embedding").cast("array<double>"), scale).alias("raw"))
    base = written(base.where("raw is not null").dropDuplicates(["vec_id", "raw"]), "quantised").withColumn("dim", F.length("raw"))
    shards = max(1, -(-base.count() // shard))
    columns = ["shard", "dim", "asks", F.col("vec_id").cast("long").alias("vec_id"), "raw"]
    held = base.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "raw"), F.lit(shards)).cast("int"), "asks": F.lit(False)})
    asked = base.where(F.col("vec_id") % every == 0).withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "asks": F.lit(True)})
    both = held.select(*columns).unionByName(asked.select(*columns)).repartition(max(partitions(vectors), min(shards, 10_000)), "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, k)

    found = both.sortWithinPartitions("shard", "dim", "asks").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
