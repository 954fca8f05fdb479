"""Nearest neighbours and radius search by cosine distance, exact in blocks or over an inverted-file index.

Reference rows are dealt to shards once. Queries go to every shard (or, with an index, to the shards of the parts they probe) and stream past it in blocks, and
numpy multiplies two matrices and keeps what can be in the result. Nothing is a cross join of rows, no row of the reference is copied, and a task
holds one shard and one block, whatever the size of the data.

Hits within a distance can be a share of all pairs. Then they aren't shuffled, and neither are rows for each query: queries are dealt to groups of a bounded number of hits, which are counted first, and rows
are packed into blocks in the shared folder once. A group is a task that reads all blocks one after another; its hits are ranked there and get their metadata.

Where ``k`` is large, shards would each return ``k`` rows: then a first pass counts distances by ranges, which gives each query a bound of its k-th distance, and the second returns what lies within.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.sources.shared import settled

#: Rows of a block of queries at most; bytes of vectors in a shard, on average; rows of a shard from which on there are as many shards as cores.
BLOCK, SHARD_BYTES, SHARD = 1024, 1 << 25, 8192
#: Distances that a task holds at once: a block of queries has fewer rows, the more rows the shard has.
CELLS = 1 << 20
#: Neighbours from which on distances are counted first, and the ranges they are counted in.
LARGE, RANGES = 1024, 1024
#: Pairs of queries and rows up to which hits within a distance aren't counted, hits that one task ranks and that are sorted at a time, what a hit takes that is shuffled, and how many times what all rows take hits may.
FEW, GATHERED, SORTED, HIT_BYTES, TIMES = 1 << 22, 1 << 24, 1 << 18, 24, 4
#: Rows, and bytes of vectors, of a block that is read as one row, at most.
PACKED, PACKED_BYTES = 4096, 1 << 21
#: Bytes of vectors of a reference that every task gets whole, of at most ``SHARD`` rows.
HAND_BYTES = 1 << 22
#: Label sums that are broadcast at once: so many vectors, and bytes, at most.
LABELS, SUM_BYTES = 10_000, 1 << 26
#: What angles are widened by before anything is skipped: cosines of near vectors tell them apart no better.
SLACK = 1e-6


def vector_bytes(vector: Column | str, unit: bool = True, narrow: bool = False) -> Column:
    """Each vector, at length 1 if ``unit``, as 64-bit floats in bytes; null for null and empty vectors, and at length 1 for zero and broken ones.

    ``narrow`` tells that they are 32-bit floats: then those that have a length come as they are, in half the bytes, for ``_unit`` to bring to length 1.
    """

    @F.arrow_udf(returnType=T.BinaryType())
    def packed(column: pa.Array) -> pa.Array:
        lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        values = np.asarray(column.flatten().fill_null(float("nan")), dtype=np.float64)
        ends, out = np.cumsum(lengths), [None] * len(lengths)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            rows = values[(ends[at] - n)[:, None] + np.arange(n)]
            if unit:
                size = np.sqrt((rows * rows).sum(1))
                fine = np.isfinite(size) & (size > 0)
                at, rows = at[fine], rows[fine].astype(np.float32) if narrow else rows[fine] / size[fine][:, None]
            for i, row in zip(at, rows, strict=True):
                out[i] = row.tobytes()
        return pa.array(out, pa.binary())

    return packed((F.col(vector) if isinstance(vector, str) else vector).cast("array<double>"))


def unit_bytes(vector: Column | str) -> Column:
    return vector_bytes(vector)


def _unit(data: bytes, n: int, narrow: bool) -> np.ndarray:
    """The ``n`` unit vectors of bytes of ``vector_bytes``."""
    if not narrow:
        return np.frombuffer(data).reshape(n, -1)
    x = np.frombuffer(data, np.float32).reshape(n, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


class Shard:
    """Reference rows of one shard and part in the order of their ids, with the number (an angle, or nothing) that came with each."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, extra: np.ndarray):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, matrix, extra = ids[order], matrix[order], extra[order]
        self.ids, self.matrix, self.extra = ids, matrix, extra
        self.columns, self.by_extra = self.matrix.T, None

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Shard:
        """Of the rows of several batches, which are let go of one by one as they are copied: a task holds a shard once, not twice."""
        n = sum(len(ids) for ids, _, _ in parts)
        ids, matrix, extra = np.empty(n, np.int64), np.empty((n, parts[0][1].shape[1])), np.empty(n)
        while parts:
            own = parts.pop()
            at = slice(n - len(own[0]), n)
            ids[at], matrix[at], extra[at] = own
            n -= len(own[0])
        return cls(ids, matrix, extra)

    def sorted_by_extra(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and numbers in the order of the numbers."""
        if self.by_extra is None:
            order = np.argsort(self.extra, kind="stable")
            self.by_extra = self.ids[order], self.matrix[order].T.copy(), self.extra[order]
        return self.by_extra


#: What a task makes of a block of queries (ids, vectors, their numbers) and a shard.
Emit = Callable[[np.ndarray, np.ndarray, np.ndarray, Shard], Iterator[pa.RecordBatch]]

HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])
HITS_DDL = "query_id long, id long, dist double"


def _streamed(batches: Iterator[pa.RecordBatch], emit: Emit) -> Iterator[pa.RecordBatch]:
    """Batches (shard, key, dim, asks, id, extra, raw), sorted by the first five, so that a shard's rows come before its queries, in the order of their ids."""
    current, rows, held = None, [], None
    for batch in batches:
        names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
        for at, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(batch)]]), strict=True):
            if at == end:
                continue
            here = tuple(x[at] for x in names[:3])
            if here != current:
                current, rows, held = here, [], None
            ids, extra = (batch.column(i).slice(at, end - at).to_numpy(zero_copy_only=False) for i in (4, 5))
            data = np.frombuffer(b"".join(batch.column(6).slice(at, end - at).to_pylist())).reshape(end - at, -1)
            if not names[3][at]:
                rows.append((ids, data, extra))
                continue
            if held is None:
                if not rows:
                    continue
                held = Shard.of(rows)
            size = max(1, min(BLOCK, CELLS // len(held.ids)))
            for part in range(0, end - at, size):
                yield from emit(ids[part : part + size], data[part : part + size], extra[part : part + size], held)


def _prepared(rows: DataFrame, name: str, asks: bool, key: str | None, extra: str | None, narrow: bool = False, *more: Column) -> DataFrame:
    number = F.col(extra).cast("double") if extra else F.lit(0.0)
    out = rows.select((F.col(key) if key else F.lit(0)).cast("long").alias("_k"), F.lit(asks).alias("_asks"), F.col(name).cast("long").alias("_id"), number.alias("_x"), vector_bytes("vector", narrow=narrow).alias("_raw"), *more)
    return out.where("_raw is not null").withColumn("_d", F.length("_raw"))


def _shards(reference: DataFrame, key: str | None) -> int:
    """Shards of each part; the largest part decides, as all are cut alike."""
    sums = [F.count("*").alias("rows"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("numbers")]
    most = (reference.groupBy(key).agg(*sums).agg(F.max("rows"), F.max("numbers")) if key else reference.agg(*sums)).first()
    rows, numbers = most[0] or 0, most[1] or 0
    return max(1, -(-8 * numbers // SHARD_BYTES), min(-(-rows // SHARD), reference.sparkSession.sparkContext.defaultParallelism))


def _blocked(queries: DataFrame, reference: DataFrame, emit: Emit, schema: str = HITS_DDL, key: str | None = None, extra: str | None = None, shards: int | None = None) -> DataFrame:
    """What ``emit`` makes of each block of ``queries`` (query_id, vector) and shard of ``reference`` (id, vector).

    With ``key`` only rows of equal key meet: an inverted-file search. ``extra`` names a number of both sides that goes along.
    """
    spark = queries.sparkSession
    shards = shards or _shards(reference, key)
    columns = ["_s", "_k", "_d", "_asks", "_id", "_x", "_raw"]
    # few shards meet the queries in several slices, so that a small reference doesn't keep one core busy; a query's rows are in one slice
    slices = 1 if key else max(1, spark.sparkContext.defaultParallelism // shards)
    held = _prepared(reference, "id", False, key, extra).withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    asked = _prepared(queries, "query_id", True, key, extra).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    if slices > 1:
        held = held.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.col("_s") * slices + i)))
        asked = asked.withColumn("_s", F.col("_s") * slices + F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards * slices, 10_000))
    both = held.select(*columns).union(asked.select(*columns))
    dealt = both.repartition(width, "_s", "_k") if key else both.repartitionById(width, F.pmod("_s", F.lit(width)))
    both = dealt.sortWithinPartitions("_s", "_k", "_d", "_asks", "_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, emit)

    return both.mapInArrow(search, schema)


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """``hits`` with ``rank`` from 1 by distance, then id; only the first ``k`` of each query if given."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id")))
    return out if k is None else out.where(F.col("rank") <= k)


def ranked_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranked`` of hits of which a query may have as many as there are rows.

    With fewer ``queries`` than shuffle partitions, rows are dealt by ranges of query, distance and id, and what stands before a range is counted: so a query's hits don't go through one task.
    """
    spark = hits.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if len(queries.select("query_id").head(parts)) == parts:
        return ranked(hits)
    dealt = settled(settled(hits).repartitionByRange(parts, "query_id", "dist", "id").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range and one more a query at most
    starts = dealt.groupBy("_part", "query_id").count().select("_part", "query_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part", "query_id").orderBy("dist", "id"))
    return dealt.withColumn("_n", place).join(F.broadcast(starts), ["_part", "query_id"]).withColumn("rank", (F.col("_n") + F.col("_start")).cast("int")).drop("_part", "_n", "_start")


def _hits(queries: np.ndarray, ids: np.ndarray, dist: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries[rows]), pa.array(ids[columns]), pa.array(dist[rows, columns])], schema=HITS)


def _first(k: int, bounded: bool = False) -> Emit:
    """The first ``k`` of each query by distance, then id; if ``bounded``, of those within the query's number."""

    def emit(asked: np.ndarray, vectors: np.ndarray, extra: np.ndarray, shard: Shard) -> Iterator[pa.RecordBatch]:
        dist = 1.0 - vectors @ shard.columns
        n = min(k, dist.shape[1])
        cut = np.partition(dist, n - 1, axis=1)[:, n - 1 : n]
        if bounded:
            cut = np.minimum(cut, extra[:, None])
        rows, columns = np.nonzero(dist <= cut)
        if len(rows) > n * len(asked) or np.bincount(rows, minlength=1).max(initial=0) > n:
            # ids ascend with columns; of equal distances the smaller ids stay
            order = np.lexsort((columns, dist[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            rows, columns = rows[place < n], columns[place < n]
        yield _hits(asked, shard.ids, dist, rows, columns)

    return emit


def _counts(k: int) -> Emit:
    """How many rows have distances in each of ``RANGES`` ranges, finer for nearer ones, up to the range that holds the shard's k-th."""

    def emit(asked: np.ndarray, vectors: np.ndarray, extra: np.ndarray, shard: Shard) -> Iterator[pa.RecordBatch]:
        dist = 1.0 - vectors @ shard.columns
        place = np.minimum((np.sqrt(np.clip(dist, 0, 2) / 2) * RANGES).astype(np.int64), RANGES - 1)
        counts = np.bincount((place + np.arange(len(asked))[:, None] * RANGES).ravel(), minlength=len(asked) * RANGES).reshape(len(asked), RANGES)
        needed = np.cumsum(counts, axis=1) - counts < k
        rows, ranges = np.nonzero((counts > 0) & needed)
        yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(ranges.astype(np.int32)), pa.array(counts[rows, ranges])], ["query_id", "range", "n"])

    return emit


def bounds(queries: DataFrame, reference: DataFrame, k: int, key: str | None = None, shards: int | None = None) -> DataFrame:
    """``(query_id, bound)``: a distance within which each query has ``k`` reference rows, if there are as many, and few more."""
    counts = _blocked(queries, reference, _counts(k), "query_id long, range int, n long", key, shards=shards).groupBy("query_id", "range").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("query_id").orderBy("range"))
    reached = counts.withColumn("_n", so_far).where(F.col("_n") >= k).groupBy("query_id").agg(F.min("range").alias("range"))
    return reached.select("query_id", (2 * ((F.col("range") + 1) / RANGES) ** 2 + 1e-9).alias("bound"))


def _nearest(queries: DataFrame, reference: DataFrame, k: int, key: str | None = None) -> DataFrame:
    shards = _shards(reference, key)
    if k < LARGE or (shards == 1 and key is None):
        return _blocked(queries, reference, _first(k), key=key, shards=shards)
    limited = queries.join(bounds(queries, reference, k, key, shards), "query_id", "left").withColumn("_bound", F.coalesce("bound", F.lit(4.0)))
    return _blocked(limited, reference.withColumn("_bound", F.lit(0.0)), _first(k, bounded=True), key=key, extra="_bound", shards=shards)


def nearest(queries: DataFrame, reference: DataFrame, k: int = 50) -> DataFrame:
    """``(query_id, rank, id, dist)``: the exact ``k`` nearest reference rows of each query.

    ``queries``: (query_id, vector); ``reference``: (id, vector). Null, zero and non-finite vectors, and those of another length, take no part.
    """
    return ranked(_nearest(queries, reference, k), k).select("query_id", "rank", "id", "dist")


def _all_within(max_dist: float) -> Emit:
    def emit(asked: np.ndarray, vectors: np.ndarray, extra: np.ndarray, shard: Shard) -> Iterator[pa.RecordBatch]:
        dist = 1.0 - vectors @ shard.columns
        yield _hits(asked, shard.ids, dist, *np.nonzero(dist <= max_dist))

    return emit


def hits_within(queries: DataFrame, reference: DataFrame, max_dist: float) -> DataFrame:
    """``within`` without ranks."""
    return _blocked(queries, reference, _all_within(max_dist))


def within(queries: DataFrame, reference: DataFrame, max_dist: float, metadata: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, id, dist)``: all reference rows at a distance of at most ``max_dist``, joined to ``metadata`` (id, ...) if given. Filter the reference before."""
    return ranked_within(queries, reference, _all_within(max_dist), queries, metadata)


def ranked_within(asked: DataFrame, reference: DataFrame, emit: Emit, queries: DataFrame, metadata: DataFrame | None = None, key: str | None = None, extra: str | None = None) -> DataFrame:
    """``(query_id, rank, id, dist)`` of all that ``emit`` finds for ``queries``, joined to ``metadata`` (id, ...) if given; ``asked`` are the queries with ``key`` and ``extra``, as for ``_blocked``.

    Hits that are few, or take at most ``TIMES`` what the rows take, are shuffled by query, and so are those of a query that alone has too many for a task to hold.
    """

    def shuffled(asked: DataFrame, queries: DataFrame) -> DataFrame:
        hits = ranked_hits(_blocked(asked, reference, emit, key=key, extra=extra), queries).select("query_id", "rank", "id", "dist")
        return hits if metadata is None else hits.join(metadata, "id")

    size = F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))
    n, numbers = queries.agg(F.count("*"), size).first()
    rows, row_numbers = reference.agg(F.count("*"), size).first()
    if n * rows <= FEW:
        return shuffled(asked, queries)
    narrow = asked.schema["vector"].dataType == reference.schema["vector"].dataType == T.ArrayType(T.FloatType())
    blocks = _kept(reference, narrow, metadata, key, extra)
    cores, size = queries.sparkSession.sparkContext.defaultParallelism, -(-8 * numbers // SHARD_BYTES)
    counts = settled(_met(asked, blocks, lambda batches: _counted(batches, emit, narrow), "query_id long, n long", max(2 * cores, size), narrow, key, extra).groupBy("query_id").agg(F.sum("n").alias("n")))
    most = GATHERED // 4
    light = counts.where(F.col("n") <= most)
    total = light.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(-(-6 * total // (5 * GATHERED)), size, cores)
    while (light.groupBy(_group(groups)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > GATHERED:
        groups *= 2
    if TIMES * ((4 if narrow else 8) * row_numbers + HIT_BYTES * rows) >= HIT_BYTES * total:
        return shuffled(asked, queries)
    heavy = counts.where(F.col("n") > most).select("query_id")
    fields = None if metadata is None else [f for f in metadata.schema if f.name != "id"]
    base = [T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())]
    schema, names = T.StructType(base + [T.StructField(f.name, f.dataType) for f in fields or []]), None if fields is None else [f.name for f in fields]

    def gathered(asked: DataFrame) -> DataFrame:
        """Each group of queries in one task, where its hits are ranked."""
        return _met(asked, blocks, lambda batches: _ranked_group(batches, emit, narrow, names), schema, groups, narrow, key, extra)

    if not heavy.take(1):
        return gathered(asked)
    out = gathered(asked.join(heavy, "query_id", "left_anti"))
    return out.unionByName(shuffled(asked.join(heavy, "query_id", "left_semi"), queries.join(heavy, "query_id", "left_semi")))


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(groups)).cast("int")


def _in_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``_prepared``, in order within their partitions, packed: a row (*keys, ids, x, raw) for up to ``PACKED`` rows in turn that have the same ``keys``, of which ``_d`` is one, and ``meta`` if they have ``_meta``."""
    listing = "_meta" in rows.columns
    fields = [rows.schema[c] for c in keys] + [T.StructField(c, T.BinaryType()) for c in ("ids", "x", "raw")]
    if listing:
        fields.append(T.StructField("meta", T.ArrayType(rows.schema["_meta"].dataType)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("_id").null_count:
                raise ValueError("an id is null")
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
            for low, high in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(batch)]]), strict=True):
                size = max(1, min(PACKED, PACKED_BYTES // max(1, batch.column("_d")[low].as_py()))) if low < high else 1
                for at in range(low, high, size):
                    part = batch.slice(at, min(size, high - at))
                    ids, x = (part.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("_id", "_x"))
                    columns = [part.column(c).slice(0, 1) for c in keys] + [pa.array([v], pa.binary()) for v in (ids, x, b"".join(part.column("_raw").to_pylist()))]
                    if listing:
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part.column("_meta")])))
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(pack, T.StructType(fields))


def _kept(reference: DataFrame, narrow: bool, metadata: DataFrame | None, key: str | None, extra: str | None) -> DataFrame:
    """All rows in blocks (_k, _d, ids, x, raw, meta) in the shared folder."""
    parts, own = _shards(reference, None), F.lit(None).cast("array<struct<_there:boolean>>")
    if metadata is not None:
        # a hit comes as often as its row has metadata; without any it only counts for the ranks
        one = F.struct(F.lit(True).alias("_there"), *(F.col(f"`{f.name}`") for f in metadata.schema if f.name != "id"))
        listed = metadata.where("id is not null").groupBy(F.col("id").cast("long").alias("_of")).agg(F.collect_list(one).alias("_meta"))
        reference, own = reference.join(listed, F.col("id").cast("long") == F.col("_of"), "left"), F.col("_meta")
    rows = _prepared(reference, "id", False, key, extra, narrow, own.alias("_meta"))
    return settled(_in_blocks(rows.repartition(parts, "_id").sortWithinPartitions("_k", "_d", "_id"), "_k", "_d"))


def at_hand(reference: DataFrame) -> tuple[dict[int, Shard], pa.Array] | None:
    """Rows (id, vector, label) that are few, as shards by the size of their vectors, and their labels by their place among all ids in order, which the shards' ids are; None if they are more than a shard's, or more than ``HAND_BYTES``, or if an id isn't unique."""
    rows, numbers = reference.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    if rows > SHARD or 8 * numbers > HAND_BYTES:
        return None
    held = reference.select(F.col("id").cast("long").alias("id"), unit_bytes("vector").alias("raw"), "label").where("raw is not null").toArrow().combine_chunks().sort_by("id")
    if held["id"].null_count or pc.count_distinct(held["id"]).as_py() < len(held):
        return None
    raw, size = held["raw"].to_pylist(), pc.binary_length(held["raw"]).to_numpy()
    own = {int(d): np.flatnonzero(size == d) for d in np.unique(size)}
    return {d: Shard(at, np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1), np.zeros(len(at))) for d, at in own.items()}, held["label"].combine_chunks()


def _met(asked: DataFrame, blocks: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, groups: int, narrow: bool, key: str | None, extra: str | None) -> DataFrame:
    """What ``work`` makes of each of so many ``groups`` of queries, a task each, which reads all ``blocks`` in turn: nothing is shuffled but the queries, once."""
    first = _prepared(asked, "query_id", True, key, extra, narrow, _group(groups).alias("_g")).repartitionById(groups, F.col("_g")).sortWithinPartitions("_k", "_d", "_id")
    packs = settled(_in_blocks(first, "_k", "_d")).toDF("_key", "_dim", "asked", "numbers", "vectors")
    # blocks as one partition: a product with each partition of queries, that neither deals rows out nor writes them, and holds one block at a time
    pairs = blocks.coalesce(1).join(packs.hint("shuffle_replicate_nl"), (F.col("_k") == F.col("_key")) & (F.col("_d") == F.col("_dim")))
    return pairs.select("asked", "numbers", "vectors", "ids", "x", "raw", "meta").mapInArrow(work, schema)


def _pairs(batches: Iterator[pa.RecordBatch], narrow: bool) -> Iterator[tuple]:
    """Of each row of ``_met``, a block of queries with a block of rows, the ids, numbers and vectors of both, and the rows' metadata."""
    for batch in batches:
        for i in range(len(batch)):
            for c in (0, 3):
                ids, numbers, raw = (batch.column(c + j)[i].as_buffer() for j in range(3))
                own = np.frombuffer(ids, np.int64), np.frombuffer(numbers), _unit(raw, ids.size // 8, narrow)
                first = own if c == 0 else first
            yield first, own, batch.column(6)[i].values


def _counted(batches: Iterator[pa.RecordBatch], emit: Emit, narrow: bool) -> Iterator[pa.RecordBatch]:
    """``(query_id, n)``: how many hits the queries of a group have, in place of the hits."""
    counts: dict[bytes, np.ndarray] = {}
    for (asked, numbers, vectors), (ids, extra, x), _ in _pairs(batches, narrow):
        n, shard, size = counts.setdefault(asked.tobytes(), np.zeros(len(asked), np.int64)), Shard(ids, x, extra), max(1, min(BLOCK, CELLS // len(ids)))
        for at in range(0, len(asked), size):
            part = slice(at, at + size)
            for found in emit(np.arange(len(asked))[part], vectors[part], numbers[part], shard):
                n += np.bincount(found.column(0).to_numpy(), minlength=len(n))
    for asked, n in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)[n > 0]), pa.array(n[n > 0])], ["query_id", "n"])


class Gathering:
    """The hits of a group of queries, as they are found."""

    def __init__(self, columns: list[str] | None):
        """``columns``: names of the metadata's, or None if there is no metadata."""
        self.listing, self.columns, self.n = columns is not None, columns or [], 0
        #: Of each piece its queries, from where to where their hits are, the hits' rows among those kept, and their distances.
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self.metadata: list[pa.Array] = []

    def add(self, asked: np.ndarray, vectors: np.ndarray, extra: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], metadata: list[pa.Array], emit: Emit) -> None:
        """What ``emit`` finds of ``rows``; ``asked`` ascends."""
        ids = np.concatenate([own for own, _, _ in rows])
        ends = np.cumsum([len(own) for own, _, _ in rows])
        shard = Shard.of([(np.arange(end - len(own), end), x, number) for end, (own, x, number) in zip(ends, rows, strict=True)])
        found, size = [], max(1, min(BLOCK, CELLS // len(ids)))
        for at in range(0, len(asked), size):
            for batch in emit(np.arange(at, min(at + size, len(asked))), vectors[at : at + size], extra[at : at + size], shard):
                found.append([batch.column(i).to_numpy() for i in range(3)])
        query, row, dist = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(query):
            return
        if (query[1:] < query[:-1]).any():
            order = np.argsort(query, kind="stable")
            query, row, dist = query[order], row[order], dist[order]
        used = np.zeros(len(ids), bool)
        used[row] = True
        names, first = np.unique(asked, return_index=True)
        starts = np.searchsorted(query, np.concatenate([first, [len(asked)]]))
        self.pieces.append((names, starts, (self.n - 1 + np.cumsum(used))[row].astype(np.int32), dist))
        self.ids.append(ids[used])
        if self.listing:
            self.metadata.append(pa.concat_arrays(metadata).filter(pa.array(used)))
        self.n += int(used.sum())

    def ranked(self) -> Iterator[pa.RecordBatch]:
        """The hits with ranks by distance, then id, and their rows' metadata."""
        if not self.pieces:
            return
        ids = np.concatenate(self.ids)
        metadata = pa.concat_arrays(self.metadata) if self.listing else None
        names = np.unique(np.concatenate([x[0] for x in self.pieces]))
        n = np.zeros(len(names), np.int64)
        for own, starts, _, _ in self.pieces:
            n[np.searchsorted(names, own)] += np.diff(starts)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // SORTED)) + 1
        for low, high in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(names)]]), strict=True):
            parts = []
            for own, starts, row, dist in self.pieces:
                a, b = np.searchsorted(own, names[low]), np.searchsorted(own, names[high - 1], side="right")
                parts.append((np.repeat(own[a:b], np.diff(starts[a : b + 1])), row[starts[a] : starts[b]], dist[starts[a] : starts[b]]))
            query, row, dist = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids[row], dist, query))
            query, row, dist = query[order], row[order], dist[order]
            rank = (np.arange(len(query)) - np.searchsorted(query, query) + 1).astype(np.int32)
            for at in range(0, len(query), SORTED):
                part = slice(at, at + SORTED)
                columns, more = [pa.array(x) for x in (query[part], rank[part], ids[row[part]], dist[part])], []
                if metadata is not None:
                    own = metadata.take(pa.array(row[part]))
                    parents = pc.list_parent_indices(own)
                    columns = [x.take(parents) for x in columns]
                    more = pc.list_flatten(own).flatten()[1:]
                yield pa.RecordBatch.from_arrays([*columns, *more], ["query_id", "rank", "id", "dist", *self.columns])


def _ranked_group(batches: Iterator[pa.RecordBatch], emit: Emit, narrow: bool, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    """The ranked hits of a group, whose tasks hold no others."""
    group = Gathering(columns)
    for (asked, numbers, vectors), (ids, extra, x), metadata in _pairs(batches, narrow):
        group.add(asked, vectors, numbers, [(ids, x, extra)], [metadata], emit)
    yield from group.ranked()


def _matrix(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist())).reshape(len(raw), -1)


def _label_sums(rows: DataFrame) -> DataFrame:
    """``(label, size, n, length, sum)`` of rows (label, raw): of each label's vectors of one size their number, squared lengths and sum. Tasks add up before anything is shuffled."""
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"label {kind}, size long, n long, length double, sum binary"

    def batch_of(label: pa.Array, raw: pa.Array, size: int) -> pa.RecordBatch:
        coded, x = label.dictionary_encode(), _matrix(raw)
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary)))
        sums = np.add.reduceat(x[order], starts, axis=0)
        n, length = np.bincount(code), np.bincount(code, (x * x).sum(1))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(n), size)), pa.array(n), pa.array(length), pa.array([v.tobytes() for v in sums], pa.binary())], ["label", "size", "n", "length", "sum"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1))
            for size in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, size))
                yield batch_of(part.column(0), part.column(1), size)

    def add(table: pa.Table) -> pa.Table:
        total = _matrix(table["sum"]).sum(0)
        return pa.table({"label": table["label"].slice(0, 1), "size": table["size"].slice(0, 1), "n": pa.array([pc.sum(table["n"]).as_py()]), "length": pa.array([pc.sum(table["length"]).as_py()]), "sum": pa.array([total.tobytes()], pa.binary())})

    return rows.select("label", "raw").mapInArrow(partial, schema).groupBy("label", "size").applyInArrow(add, schema)


def distance_sums(rows: DataFrame, squared: bool = False) -> DataFrame:
    """``(id, label, other, total, n)``: of each row (id, label, vector) the sum of distances to the other rows of each label, and their number.

    Cosine distances, or squared Euclidean ones. Both are linear in inner products, so a row needs the labels' sums of vectors only: tasks multiply
    batches of rows by a matrix of at most ``LABELS`` such sums and ``SUM_BYTES``, which is what is broadcast at once. Vectors of another length than most take no part.
    """
    spark = rows.sparkSession
    used = rows.where("label is not null").select("id", "label", vector_bytes("vector", unit=not squared).alias("raw")).where("raw is not null")
    groups = settled(_label_sums(used))
    most = groups.groupBy("size").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).orderBy(F.desc("n"), "size").first()
    size, labels = (most["size"], most["labels"]) if most else (0, 0)
    used, groups = used.where(F.length("raw") == size), groups.where(F.col("size") == size)
    chunks = max(1, -(-labels // max(1, min(LABELS, SUM_BYTES // max(size, 1)))))
    kind = used.schema["label"].dataType
    out = None
    for chunk in range(chunks):
        table = groups.where(F.pmod(F.xxhash64("label"), F.lit(chunks)) == chunk).toArrow().combine_chunks().sort_by("label")
        shared = spark.sparkContext.broadcast(table)

        def work(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            if not len(table):
                return
            names, n, size, matrix = table["label"].combine_chunks(), table["n"].to_numpy(), table["length"].to_numpy(), _matrix(table["sum"])
            step = max(1, (1 << 19) // len(names))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    x = _matrix(part.column(2))
                    own = np.array(pc.index_in(part.column(1), value_set=names).fill_null(-1))[:, None] == np.arange(len(names))[None, :]
                    inner, length = x @ matrix.T, (x * x).sum(1)[:, None]
                    total = n * length + size - 2 * inner if squared else (n - own) - (inner - own * length)
                    count = np.broadcast_to(n, own.shape) - own
                    row, column = np.nonzero(count > 0)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), names.take(column), pa.array(total[row, column]), pa.array(count[row, column])], ["id", "label", "other", "total", "n"])

        schema = T.StructType([used.schema["id"], T.StructField("label", kind), T.StructField("other", kind), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
        found = used.mapInArrow(work, schema)
        out = found if out is None else out.union(found)
    return out
