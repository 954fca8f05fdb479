"""Labels by the vote of nearest neighbours, with measures of how clear the vote is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.inverted import InvertedFile
from kindred.operators.neighbours import BLOCK, CELLS, Shard, _first, at_hand, nearest, unit_bytes
from kindred.operators.search import Index

#: Distances count as at least this in weighted votes.
FLOOR = 1e-6


def condition(safelist: list[str] | None = None, blocklist: list[str] | None = None) -> Column | None:
    """What a row's label must be: in the safelist, or not in the blocklist; give one of them at most."""
    if safelist is not None and blocklist is not None:
        raise ValueError("a safelist and a blocklist exclude each other")
    if safelist is not None:
        return F.col("label").isin(safelist)
    return None if blocklist is None else ~F.coalesce(F.col("label").isin(blocklist), F.lit(False))


def allowed(reference: DataFrame, safelist: list[str] | None = None, blocklist: list[str] | None = None) -> DataFrame:
    """Reference rows that meet ``condition``; raises ValueError if no row has a label of the safelist."""
    wanted = condition(safelist, blocklist)
    kept = reference if wanted is None else reference.where(wanted)
    if safelist is not None and not kept.take(1):
        raise ValueError("no reference row has a label of the safelist")
    return kept


def votes(hits: DataFrame) -> DataFrame:
    """``(query_id, label, hits, hits_weighted, first_rank)`` of hits with labels."""
    weight = 1.0 / F.greatest(F.col("dist"), F.lit(FLOOR))
    return hits.groupBy("query_id", "label").agg(F.count("*").alias("hits"), F.sum(weight).alias("hits_weighted"), F.min("rank").alias("first_rank"))


def predictions(hits: DataFrame, weighting: bool = False) -> DataFrame:
    """``(query_id, prediction, hits, hits_weighted, min_dist, max_dist, vs2nd, vs_all, weighted_vs2nd, weighted_vs_all)``.

    ``hits``: (query_id, rank, dist, label). The label of most hits wins, or of most weight; of equals the one seen
    first. ``vs2nd``: the largest number of hits over it and the second; ``vs_all``: over all, whichever label won; 1 for a lone
    label. ``hits`` and ``hits_weighted`` are maps by label.
    """
    counted = votes(hits)
    best = F.struct(F.col("hits_weighted" if weighting else "hits").cast("double").alias("n"), (-F.col("first_rank")).alias("r"), F.col("label").alias("label"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", c)))).alias(c)
    down = lambda c: F.sort_array(F.collect_list(F.col(c).cast("double")), asc=False).alias(f"_{c}")
    by_query = counted.where("label is not null").groupBy("query_id").agg(F.max(best).alias("_best"), pairs("hits"), pairs("hits_weighted"), down("hits"), down("hits_weighted"))
    spans = hits.groupBy("query_id").agg(F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    second = lambda c: F.when(F.size(c) > 1, F.col(c)[0] / (F.col(c)[0] + F.col(c)[1])).otherwise(1.0)
    return by_query.join(spans, "query_id").select(
        "query_id",
        F.col("_best.label").alias("prediction"),
        "hits",
        "hits_weighted",
        "min_dist",
        "max_dist",
        second("_hits").alias("vs2nd"),
        (F.col("_hits")[0] / total("_hits")).alias("vs_all"),
        second("_hits_weighted").alias("weighted_vs2nd"),
        (F.col("_hits_weighted")[0] / total("_hits_weighted")).alias("weighted_vs_all"),
    )


def annotate(queries: DataFrame, reference: DataFrame, k: int = 50, weighting: bool = False, exclude_self: bool = False, index: Index | None = None, safelist: list[str] | None = None, blocklist: list[str] | None = None) -> DataFrame:
    """Predictions for ``queries`` (query_id, vector) from ``reference`` (id, vector, label), of the labels that the lists allow.

    With an ``index`` of the reference neighbours come from it. An inverted file whose rows have labels keeps to the lists itself; they can't be given with another index.
    """
    n, wanted = k + 1 if exclude_self else k, condition(safelist, blocklist)
    if index is None:
        reference = allowed(reference, safelist, blocklist)
        hits = nearest(queries, reference, n)
    elif wanted is None:
        hits = index.nearest(queries, n)
    elif isinstance(index, InvertedFile):
        allowed(index.rows, safelist, blocklist)
        hits = index.nearest(queries, n, allowed=wanted)
    else:
        raise ValueError("this index knows no labels")
    if exclude_self:
        again = Window.partitionBy("query_id").orderBy("rank")
        hits = hits.where("id <> query_id").withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    return predictions(hits.join(reference.select("id", "label"), "id"), weighting)


def _vote(dist: np.ndarray, place: np.ndarray, code: np.ndarray, rows: int, labels: int, weighting: bool) -> dict[str, np.ndarray]:
    """``predictions`` of hits in the order of row ``place`` and rank; a ``code`` of -1 is no label. Matrices are by row and label."""
    starts = np.searchsorted(place, np.arange(rows + 1))
    valid = np.flatnonzero(code >= 0)
    cell, n = place[valid] * labels + code[valid], rows * labels
    first = np.full(n, len(place))
    first[cell[::-1]] = valid[::-1]
    hits, weights = np.bincount(cell, minlength=n).reshape(rows, labels), np.bincount(cell, 1.0 / np.maximum(dist[valid], FLOOR), n).reshape(rows, labels).astype(np.float64)
    score = weights if weighting else hits
    out = {"hits": hits, "hits_weighted": weights, "best": np.where((score == score.max(1, keepdims=True)) & (hits > 0), first.reshape(rows, labels), len(place)).argmin(1)}
    some = hits.any(1)
    out["min_dist"], out["max_dist"] = (np.append(dist, np.nan)[np.where(some, at, -1)] for at in (starts[:-1], starts[1:] - 1))
    for name, x in (("", hits.astype(np.float64)), ("weighted_", weights)):
        down = -np.sort(-x, axis=1)
        second = down[:, 1] if labels > 1 else 0.0
        with np.errstate(invalid="ignore"):
            out[f"{name}vs2nd"], out[f"{name}vs_all"] = down[:, 0] / (down[:, 0] + second), down[:, 0] / np.cumsum(down, axis=1)[:, -1]
    return out | {"some": some}


def annotated_rows(rows: DataFrame, reference: DataFrame, k: int = 50, weighting: bool = False) -> DataFrame | None:
    """``rows``, which have a ``vector``, each with the columns of its own ``predictions``, or nulls; None if ``reference`` (id, vector, label) is too large, or its labels not such, that every task can get it whole.

    Rows are neither dealt out nor joined, and neither are hits: a row's vote is taken where its neighbours are found.
    """
    kind = reference.schema["label"].dataType
    held = at_hand(reference) if isinstance(kind, (T.StringType, T.IntegralType)) else None
    if held is None:
        return None
    shards, own = held
    names = pc.unique(own.drop_null()).sort()
    shared = rows.sparkSession.sparkContext.broadcast((shards, np.asarray(pc.index_in(own, value_set=names).fill_null(-1), dtype=np.int64), names))
    doubles = ["min_dist", "max_dist", "vs2nd", "vs_all", "weighted_vs2nd", "weighted_vs_all"]
    maps = [T.StructField("hits", T.MapType(kind, T.LongType())), T.StructField("hits_weighted", T.MapType(kind, T.DoubleType()))]
    schema = T.StructType([*rows.schema.fields, T.StructField("prediction", kind), *maps, *(T.StructField(c, T.DoubleType()) for c in doubles)])
    columns = rows.columns

    def voted(batch: pa.RecordBatch, shard: Shard | None, codes: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        """``batch`` of vectors of one size."""
        if shard is None or not len(names):
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.nulls(len(batch), names.type), *(pa.nulls(len(batch), pa.map_(names.type, x)) for x in (pa.int64(), pa.float64())), *[pa.nulls(len(batch), pa.float64())] * len(doubles)], schema.names)
        x = np.frombuffer(b"".join(batch.column(len(columns)).to_pylist())).reshape(len(batch), -1)
        (found,) = _first(k)(np.arange(len(batch)), x, np.zeros(0), shard)
        place, at, dist = (found.column(i).to_numpy() for i in range(3))
        order = np.lexsort((at, dist, place))
        out = _vote(dist[order], place[order], codes[at[order]], len(batch), len(names), weighting)
        none, counted = ~out["some"], out["hits"] > 0
        ends, label = pa.array(np.concatenate([[0], np.cumsum(counted.sum(1))]), pa.int32()), names.take(pa.array(np.nonzero(counted)[1]))
        pairs = [pa.MapArray.from_arrays(ends, label, pa.array(out[c][counted]), type=pa.map_(names.type, pa.int64() if c == "hits" else pa.float64()), mask=pa.array(none)) for c in ("hits", "hits_weighted")]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], names.take(pa.array(out["best"], mask=none)), *pairs, *(pa.array(out[c], mask=none) for c in doubles)], schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, codes, names = shared.value
        size = max(1, min(BLOCK, CELLS // max(len(codes), 1)))
        for batch in batches:
            sizes = pc.binary_length(batch.column(len(columns))).fill_null(-1)
            for d in pc.unique(sizes).to_pylist():
                some = batch.filter(pc.equal(sizes, d))
                for at in range(0, len(some), size):
                    yield voted(some.slice(at, size), shards.get(d), codes, names)

    return rows.withColumn("_raw", unit_bytes("vector")).mapInArrow(work, schema)


def classes(reference: DataFrame) -> DataFrame:
    return reference.select("label").where("label is not null").distinct()
