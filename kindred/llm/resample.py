"""Importance resampling toward a target: documents drawn without replacement, likelier the more their words are those of the target.

Features are hashed to ``buckets`` counters. A bucket's gain is the log-ratio of its share in the target to its share in the corpus, in whole thousandths; a document's
weight is the sum of its features' gains, looked up in one array that is as long as there are buckets, whatever the corpus. A Gumbel variate that depends on the document's id alone is added,
so the highest scores are an exact draw by weight.

Each partition's eligible rows are sorted and written: a run. The runs are cut at common scores into ranges of bounded size; a task takes its range's slice of every run and merges them
by a tournament tree. Ranges are counted first, so each knows the rank it starts from, and the merge stops after the exact number drawn: lower ranges are never merged, nor
is the rest of the last one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import new_path, partitions, small_batches
from kindred.llm.termwords import pieces, raw_texts

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Rows of a range, on average.
RANGE = 1 << 17
#: Features whose buckets a worker remembers.
REMEMBERED = 1 << 17


class Places(dict):
    """The bucket of each feature, by the checksum of its bytes; remembers a bounded number of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at


def features(raw: bytes, longest: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space; the first of every ``longest`` lists has the single words of a piece of the text."""
    tail: list[bytes] = []
    for words in pieces(raw):
        yield words
        both = tail + words
        for size in range(2, longest + 1):
            yield [b" ".join(both[i : i + size]) for i in range(max(0, len(tail) - size + 1), len(both) - size + 1)]
        tail = both[1 - longest :] if longest > 1 else []


def _places(found: list[bytes], places: Places) -> np.ndarray:
    return np.fromiter(map(places.__getitem__, found), np.int64, len(found))


def feature_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features all texts (text) have in each bucket. A task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, places = np.zeros(buckets, np.int64), Places(buckets)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                for found in features(raw, longest):
                    totals += np.bincount(_places(found, places), minlength=buckets)
        live = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(totals[live])], ["bucket", "n"])

    with small_batches(texts.sparkSession):
        found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of each bucket, all buckets counted once more than they occur."""
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


WEIGHED = T.StructType([T.StructField(c, T.LongType()) for c in ("words", "n_features", "weight")])


def weighed(text: Column, gain: object, longest: int, buckets: int) -> Column:
    """``struct<words, n_features, weight>`` of each text; ``gain`` is a broadcast array."""

    @F.arrow_udf(returnType=WEIGHED)
    def weigh(column: pa.Array) -> pa.Array:
        table, places, out = gain.value, Places(buckets), np.zeros((3, len(column)), np.int64)
        for i, raw in enumerate(raw_texts(column)):
            for step, found in enumerate(features(raw, longest)):
                out[0, i] += len(found) if step % longest == 0 else 0
                out[1, i] += len(found)
                out[2, i] += table[_places(found, places)].sum()
        return pa.StructArray.from_arrays([pa.array(x) for x in out], WEIGHED.names)

    return weigh(text)


def gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel variate in whole thousandths, of the first 32 bits of the key's seeded hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


END = (math.inf,)


def tournament(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """What all sorted runs hold, in order, by a tree of losers: after the winner's next row enters at its leaf, only the matches on its way up are played again."""
    k, heads = len(runs), [next(run, END) for run in runs]
    won, lost = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    champion = won[1] if k > 1 else 0
    while k and heads[champion] is not END:
        yield heads[champion]
        heads[champion] = next(runs[champion], END)
        node = (champion + k) // 2
        while node:
            if heads[lost[node]] < heads[champion]:
                lost[node], champion = champion, lost[node]
            node //= 2


#: The 33 low bits of Spark's row numbers count within a partition, the others name it.
RUN_BITS = 33
ROW = ("doc_id", "n_features", "weight", "score")


def merged(batches: Iterator[pa.RecordBatch], starts: np.ndarray, drawn: int) -> Iterator[pa.RecordBatch]:
    """Batches (range, at, *ROW), sorted by range and place, to (*ROW, rank): each range's runs merged up to rank ``drawn``, the rest of its rows without one."""
    current, held = None, []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        at, ids, score = (rows[c].to_numpy() for c in ("at", "doc_id", "score"))
        edges = np.flatnonzero(np.diff(at >> RUN_BITS)) + 1
        wanted = min(len(at), max(0, drawn - int(starts[current])))
        slices = [zip((-score[a:b]).tolist(), ids[a:b].tolist(), range(a, b), strict=True) for a, b in zip([0, *edges], [*edges, len(at)], strict=True)]
        first = np.array([row[2] for _, row in zip(range(wanted), tournament(slices), strict=False)], np.int64)
        rest = np.setdiff1d(np.arange(len(at)), first, assume_unique=True)
        rank = pa.array([*range(int(starts[current]) + 1, int(starts[current]) + wanted + 1), *[None] * len(rest)], pa.int64())
        table = rows.take(pa.array(np.concatenate([first, rest]))).combine_chunks()
        return pa.RecordBatch.from_arrays([*(table[c].chunk(0) for c in ROW), rank], [*ROW, "rank"])

    for batch in batches:
        ranges = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(ranges)) + 1
        for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(ranges)]]), strict=True):
            if a == b:
                continue
            if held and ranges[a] != current:
                yield done()
                held = []
            current = int(ranges[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def ranks(rows: DataFrame, eligible: Column, percent: int, in_range: int = RANGE) -> DataFrame:
    """``rows`` (doc_id, n_features, weight, score) with ``rank``: 1, 2, 3... of the ``percent`` of every hundred eligible rows with the highest scores, ties by smaller doc_id; null elsewhere."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "runs")
    order = [F.desc("eligible"), F.desc("score"), F.asc("doc_id")]
    rows.select(*ROW, F.coalesce(eligible, F.lit(False)).alias("eligible")).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    runs = spark.read.parquet(path)
    among = runs.where("eligible").drop("eligible")
    n = among.count()
    drawn = percent * n // 100
    # equal rows differ by their place, so no range depends on how often a score or an id repeats
    cut = among.repartitionByRange(max(partitions(rows), -(-n // in_range)), F.desc("score"), F.asc("doc_id"), F.asc("at")).withColumn("range", F.spark_partition_id())
    cut.write.parquet(path := new_path(spark, "ranges"))
    ranges = spark.read.parquet(path)
    sizes = ranges.groupBy("range").count().orderBy("range").toArrow()
    names, ends = sizes["range"].to_numpy(), np.cumsum(sizes["count"].to_numpy())
    last = int(names[np.searchsorted(ends, drawn)]) if drawn else -1
    starts = np.zeros(int(names[-1]) + 1 if len(names) else 1, np.int64)
    starts[names] = ends - sizes["count"].to_numpy()
    shared = spark.sparkContext.broadcast(starts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(batches, shared.value, drawn)

    # at most as many ranges as tasks have
    upper = ranges.where(F.col("range") <= last).select("range", "at", *ROW).repartition(max(partitions(rows), min(last + 1, 10_000)), "range").sortWithinPartitions("range", "at")
    done = upper.mapInArrow(merge, ", ".join(f"{c} long" for c in (*ROW, "rank")))
    none = F.lit(None).cast("long").alias("rank")
    return done.unionByName(ranges.where(F.col("range") > last).select(*ROW, none)).unionByName(runs.where("not eligible").select(*ROW, none))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document (doc_id, text), all long; those drawn toward ``target`` (text) have a rank, from 1 for the highest score.

    Of the N documents with at least ``least_words`` words floor(percent * N / 100) are drawn, ties to the smaller doc_id. Whole texts are read; null and empty ones have no
    features and weigh 0. Every row counts and is drawn by itself, so a repeated row may have two ranks. A null doc_id has features but no score, and is never drawn. Without a target, or
    without documents, gains are those of the counts there are. Other columns aren't read.
    """
    spark = documents.sparkSession
    gain = spark.sparkContext.broadcast(gains(feature_counts(target, longest, buckets), feature_counts(documents, longest, buckets)))
    with small_batches(spark):
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), weighed(F.col("text"), gain, longest, buckets).alias("_w")).select("doc_id", "_w.*")
        rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        return ranks(rows.select(*ROW, "words"), (F.col("words") >= least_words) & F.col("doc_id").isNotNull(), percent)


def drawn_documents(documents: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose ids were drawn."""
    return documents.join(ranked.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi").select(*documents.columns)
