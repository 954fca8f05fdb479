"""A graph index for approximate nearest neighbours: a layered small world in each shard, in flat numpy arrays.

Each layer above holds one row in ``links`` of the layer below, chosen by a hash of the id. A row's candidates are its nearest rows in its layer and some of the nearest in the layer above, which are farther
away; of these it keeps the ones that are nearer to it than to any it has kept already, and rows that are kept link back. So links go in many directions, and a few of them far.

Equal vectors of a shard are one node with several ids, so copies don't fill each other's links.

A search enters at the top layer and follows links toward the query, all queries of a block at once; at the bottom it keeps the ``breadth`` nearest rows it has seen and follows
their links until none of them has an unseen neighbour. Shards are searched apart, each by several tasks with a slice of the queries, and merged by rank. More breadth finds more and compares more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.neighbours import HITS_DDL, _unit, ranked, unit_bytes, vector_bytes

#: Rows of a shard on average, and queries that are led through it together.
SHARD, BLOCK = 32_768, 256
#: Queries that a task leads through a shard at most, and at least where tasks are fewer than cores. Every slice gets the shard's rows and links again.
SLICE, LEAST = 1 << 16, 1 << 10
#: Links of a row in each layer (twice as many at the bottom), nearest rows they are chosen from, and rows of a query that are followed at once.
LINKS, POOL, STRIDE = 16, 48, 4
#: Pairs of vectors that are multiplied at a time, so that they stay in a core's cache.
PAIRS = 1 << 10
#: Rows compared with all others at a time while a shard is built.
PART = 512

ROWS_DDL = "shard int, place int, ids array<long>, raw binary, links array<array<int>>"
ROWS = pa.schema([("shard", pa.int32()), ("place", pa.int32()), ("ids", pa.list_(pa.int64())), ("raw", pa.binary()), ("links", pa.list_(pa.list_(pa.int32())))])


def _candidates(x: np.ndarray, among: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each row ``of`` x its ``n`` nearest ``among`` others, nearest first; -1 where there are fewer."""
    sims = x[of] @ x[among].T
    sims[among[None, :] == of[:, None]] = -np.inf
    n = min(n, len(among))
    at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    near = np.take_along_axis(sims, at, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    found = among[np.take_along_axis(at, order, 1)]
    return np.where(np.isneginf(np.take_along_axis(near, order, 1)), -1, found)


def _diverse(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, n: int) -> np.ndarray:
    """Of each row's candidates, nearest first, up to ``n`` that are nearer to it than to any kept before; -1 elsewhere."""
    there = candidates >= 0
    vectors = x[np.maximum(candidates, 0)]
    own = np.einsum("rcd,rd->rc", vectors, x[of])
    between = vectors @ vectors.transpose(0, 2, 1)
    kept, size = np.zeros(candidates.shape, bool), np.zeros(len(of), np.int64)
    for j in range(candidates.shape[1]):
        closer = (kept & (between[:, j] > own[:, j : j + 1])).any(1)
        kept[:, j] = there[:, j] & ~closer & (size < n)
        size += kept[:, j]
    return np.where(kept, candidates, -1)


def linked(x: np.ndarray, levels: np.ndarray, links: int = LINKS, pool: int = POOL) -> list[np.ndarray]:
    """For each layer a table (row, link) of rows, -1 where there is none; ``levels``: the highest layer of each row of ``x``, unit vectors."""
    tables = []
    for level in range(int(levels.max(initial=0)) + 1):
        members, above = np.flatnonzero(levels >= level), np.flatnonzero(levels > level)
        most = 2 * links if level == 0 else links
        out = []
        for at in range(0, len(members), PART):
            of = members[at : at + PART]
            found = _candidates(x, members, of, pool)
            if len(above):
                far = _candidates(x, above, of, pool // 3)
                far[(far[:, :, None] == found[:, None, :]).any(2)] = -1
                found = np.concatenate([found, far], axis=1)
                sims = np.where(found >= 0, np.einsum("rcd,rd->rc", x[np.maximum(found, 0)], x[of]), -np.inf)
                found = np.take_along_axis(found, np.argsort(-sims, axis=1, kind="stable"), 1)
            kept = _diverse(x, of, found, links)
            row, column = np.nonzero(kept >= 0)
            out.append(np.stack([of[row], kept[row, column]]))
        one, two = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.concatenate([one * len(x) + two, two * len(x) + one]))
        one, two = pairs // len(x), pairs % len(x)
        order = np.lexsort((-np.einsum("pd,pd->p", x[one], x[two]), one))
        one, two = one[order], two[order]
        place = np.arange(len(one)) - np.searchsorted(one, one)
        table = np.full((len(x), most), -1, np.int32)
        near = place < most
        table[one[near], place[near]] = two[near]
        tables.append(table)
    return tables


class World:
    """One shard: unit vectors of its nodes, their ids (``ids[offs[i] : offs[i + 1]]`` of node i, ascending) and the tables of its layers. ``compared`` counts distances."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, x: np.ndarray, tables: list[np.ndarray]):
        while len(tables) > 1 and not (tables[-1] >= 0).any():
            tables = tables[:-1]
        self.ids, self.offs, self.x, self.small, self.tables, self.compared = ids, offs, x, x.astype(np.float32), tables, 0
        self.entry = int((tables[-1] >= 0).any(1).argmax())

    def walk(self, queries: np.ndarray, start: np.ndarray, table: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``breadth`` nearest rows that were seen on the way from ``start`` (query, row), with their similarities; -1 where there are fewer."""
        n, all_rows = len(queries), np.arange(len(queries))
        seen = np.zeros(n * len(self.x), bool)
        ids = np.full((n, breadth), -1, np.int64)
        sims = np.full((n, breadth), -np.inf, np.float32)
        done = np.ones((n, breadth), bool)
        width = min(breadth, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qd,qwd->qw", queries, self.small[np.maximum(ids[:, :width], 0)]), -np.inf)
        done[:, :width] = ids[:, :width] < 0
        self.compared += int((ids[:, :width] >= 0).sum())
        seen[(all_rows[:, None] * len(self.x) + ids[:, :width])[ids[:, :width] >= 0]] = True
        while True:
            active = all_rows[(~done).any(1)]
            if not len(active):
                return ids, sims
            step = min(STRIDE, breadth)
            open_sims = np.where(done[active], np.inf, -sims[active])
            best = np.argpartition(open_sims, step - 1, axis=1)[:, :step] if step < breadth else np.tile(np.arange(breadth), (len(active), 1))
            follow = np.where(np.take_along_axis(done[active], best, 1), -1, ids[active[:, None], best])
            done[active[:, None], best] = True
            to = table.take(np.maximum(follow, 0).ravel(), axis=0)
            to[follow.ravel() < 0] = -1
            to = to.reshape(len(active), -1)
            pairs = (active[:, None] * len(self.x) + to)[to >= 0]
            # what is new is little, and sorting it tells what comes twice
            pairs = np.sort(pairs[~seen.take(pairs)])
            if not len(pairs):
                continue
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            seen[pairs] = True
            row, to = pairs // len(self.x), pairs % len(self.x)
            self.compared += len(row)
            sim = np.concatenate([np.einsum("pd,pd->p", queries.take(row[at : at + PAIRS], axis=0), self.small.take(to[at : at + PAIRS], axis=0)) for at in range(0, len(row), PAIRS)])
            # only what beats the worst row held can enter
            good = sim > sims.min(1)[row]
            row, to, sim = row[good], to[good], sim[good]
            if not len(row):
                continue
            first = np.concatenate([[True], row[1:] != row[:-1]])
            touched, at = row[first], np.cumsum(first) - 1
            place = np.arange(len(row)) - np.flatnonzero(first)[at]
            more_ids = np.full((len(touched), int(place.max()) + 1), -1, np.int64)
            more_sims = np.full(more_ids.shape, -np.inf, np.float32)
            more_ids[at, place], more_sims[at, place] = to, sim
            joined_sims = np.concatenate([sims[touched], more_sims], 1)
            keep = np.argpartition(-joined_sims, breadth - 1, axis=1)[:, :breadth] + np.arange(len(touched))[:, None] * joined_sims.shape[1]
            sims[touched] = joined_sims.take(keep)
            ids[touched] = np.concatenate([ids[touched], more_ids], 1).take(keep)
            done[touched] = np.concatenate([done[touched], more_ids < 0], 1).take(keep)

    def top(self, queries: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, distance) of up to ``k`` rows a query."""
        small = queries.astype(np.float32)
        start = np.full((len(queries), 1), self.entry, np.int64)
        for table in self.tables[:0:-1]:
            start, _ = self.walk(small, start, table, 4)
        found, _ = self.walk(small, start, self.tables[0], max(k, breadth))
        row, column = np.nonzero(found >= 0)
        to = found[row, column]
        dist = 1.0 - np.einsum("pd,pd->p", queries[row], self.x[to])
        size = np.minimum(self.offs[to + 1] - self.offs[to], k)
        row, dist, first = np.repeat(row, size), np.repeat(dist, size), np.repeat(self.offs[to], size)
        ids = self.ids[first + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
        order = np.lexsort((ids, dist, row))
        row, ids, dist = row[order], ids[order], dist[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[near], ids[near], dist[near]


def _built(batches: Iterator[pa.RecordBatch], links: int, pool: int) -> Iterator[pa.RecordBatch]:
    """Batches (shard, level, id, raw), sorted by shard, to the rows of their worlds."""
    current, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        raw, ids, level = rows["raw"].to_pylist(), rows["id"].to_pylist(), rows["level"].to_numpy()
        # vectors of another length than most take no part
        size = int(np.bincount([len(r) for r in raw]).argmax())
        nodes: dict[bytes, list[int]] = {}
        for i, r in enumerate(raw):
            if len(r) == size:
                nodes.setdefault(r, []).append(i)
        own = list(nodes.values())
        tables = linked(np.frombuffer(b"".join(nodes)).reshape(len(nodes), -1).astype(np.float32), level[[o[0] for o in own]], links, pool)
        for at in range(0, len(own), 1024):
            part = range(at, min(at + 1024, len(own)))
            out = [[table[i][table[i] >= 0].tolist() for table in tables[: level[own[i][0]] + 1]] for i in part]
            columns = [[current] * len(part), part, [sorted(ids[j] for j in own[i]) for i in part], [raw[own[i][0]] for i in part], out]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, ROWS.types, strict=True)], schema=ROWS)

    for batch in batches:
        shard = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(shard)) + 1
        for at, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(shard)]]), strict=True):
            if at == end:
                continue
            if held and shard[at] != current:
                yield from done()
                held = []
            current = int(shard[at])
            held.append(batch.slice(at, end - at))
    if held:
        yield from done()


def _world(held: list[pa.RecordBatch]) -> World:
    rows = pa.Table.from_batches(held)
    raw, links = rows["raw"].to_pylist(), rows["links"].combine_chunks()
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    # lists of lists, flat: a row's layers, and a layer's links
    layers, lists = np.asarray(links.value_lengths()), links.flatten()
    sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(raw)), layers)
    layer = np.arange(len(row)) - np.repeat(np.cumsum(layers) - layers, layers)
    tables = []
    for level in range(int(layers.max())):
        own = np.flatnonzero(layer == level)
        size = sizes[own]
        table = np.full((len(raw), max(1, size.max())), -1, np.int32)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        table[np.repeat(row[own], size), place] = values[np.repeat(starts[own], size) + place]
        tables.append(table)
    ids = rows["ids"].combine_chunks()
    return World(np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]), x, tables)


def _searched(batches: Iterator[pa.RecordBatch], k: int, breadth: int, count: bool, narrow: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches (task, asks, place, ids, raw, links), sorted by the first three: rows of one shard and queries, ``narrow`` as in ``vector_bytes``; a query's ids are its own alone."""
    current, held, world = None, [], None
    for batch in batches:
        shard, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1
        for at, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(shard)]]), strict=True):
            if at == end:
                continue
            if shard[at] != current:
                current, held, world = shard[at], [], None
            part = batch.slice(at, end - at)
            if not asks[at]:
                held.append(part)
                continue
            if world is None:
                if not held:
                    continue
                world, held = _world(held), []
            ids, raw = np.asarray(part.column(3).flatten()), part.column(4).to_pylist()
            fit = [i for i, r in enumerate(raw) if len(r) == (4 if narrow else 8) * world.x.shape[1]]
            for b in range(0, len(fit), BLOCK):
                some = fit[b : b + BLOCK]
                before = world.compared
                row, found, dist = world.top(_unit(b"".join(raw[i] for i in some), len(some), narrow), k, breadth)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64()), pa.array([world.compared - before], pa.int64()), pa.array([len(some) * len(world.ids)], pa.int64())], ["queries", "compared", "whole"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][row]), pa.array(found), pa.array(dist)], ["query_id", "id", "dist"])


class SmallWorld:
    """``rows`` (shard, place, ids, raw, links): every vector at length 1 with the ids that have it and its links by layer, in ``shards`` worlds."""

    def __init__(self, rows: DataFrame, shards: int, breadth: int = 128):
        self.rows, self.shards, self.breadth = rows, shards, breadth

    @classmethod
    def build(cls, reference: DataFrame, path: str, links: int = LINKS, pool: int = POOL, shard: int = SHARD, breadth: int = 128, seed: int = 4) -> SmallWorld:
        """An index of ``reference`` (id, vector), written to the folder ``path``. Null, zero and non-finite vectors take no part."""
        spark = reference.sparkSession
        shards = max(1, -(-reference.count() // shard))
        chance = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        level = F.least(F.floor(-F.log(chance) / float(np.log(links))), F.lit(8)).cast("int")
        rows = reference.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), level.alias("level"), F.col("id").cast("long").alias("id"), unit_bytes("vector").alias("raw")).where("raw is not null")
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 10_000))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _built(batches, links, pool)

        rows.repartition(width, "shard").sortWithinPartitions("shard", "id").mapInArrow(build, ROWS_DDL).write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(shards, breadth)], "shards int, breadth int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SmallWorld:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark.read.parquet(f"{path}/rows"), about["shards"], about["breadth"])

    def _slices(self, queries: DataFrame) -> int:
        """Into how many slices queries are dealt, so that shards keep all cores busy and no task has a number of queries that grows with the table."""
        n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
        return max(1, -(-n // SLICE), min(-(-2 * cores // self.shards), n // LEAST))

    def _run(self, queries: DataFrame, k: int, breadth: int | None, schema: str, count: bool) -> DataFrame:
        columns = ["task", "asks", "place", "ids", "raw", "links"]
        slices = self._slices(queries)
        task = (F.col("shard") * slices + F.col("slice")).cast("int").alias("task")
        held = self.rows.withColumn("asks", F.lit(False)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        narrow = queries.schema["vector"].dataType == T.ArrayType(T.FloatType())
        asked = queries.select(F.array(F.col("query_id").cast("long")).alias("ids"), vector_bytes("vector", narrow=narrow).alias("raw"), F.lit(True).alias("asks"), F.lit(0).alias("place"), F.lit(None).cast("array<array<int>>").alias("links")).where("raw is not null")
        asked = asked.withColumn("slice", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(slices))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        width = min(self.shards * slices, 10_000)
        both = held.select(task, *columns[1:]).union(asked.select(task, *columns[1:])).repartitionById(width, F.pmod(F.col("task"), F.lit(width))).sortWithinPartitions("task", "asks", "place")
        wide = breadth or self.breadth

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _searched(batches, k, wide, count, narrow)

        return both.mapInArrow(search, schema)

    def nearest(self, queries: DataFrame, k: int = 50, breadth: int | None = None) -> DataFrame:
        """``(query_id, rank, id, dist)``: about the ``k`` nearest rows of each query; ``breadth`` rows are kept on the way in each shard, ``k`` at least."""
        return ranked(self._run(queries, k, breadth, HITS_DDL, False), k).select("query_id", "rank", "id", "dist")

    def comparisons(self, queries: DataFrame, k: int = 50, breadth: int | None = None) -> DataFrame:
        """``(queries, compared, whole)`` in all: how many distances ``nearest`` computes, and how many an exact search would."""
        return self._run(queries, k, breadth, "queries long, compared long, whole long", True).agg(*(F.sum(c).alias(c) for c in ("queries", "compared", "whole")))

    def within(self, queries: DataFrame, max_dist: float, among: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError("a graph can't tell whether it has found all rows within a distance: use an inverted file")
