"""Substring deduplication with a log-structured fingerprint index.

The index keeps fingerprints of past text in immutable runs, each a folder of Parquet files sorted by fingerprint, named by a manifest, so that
a later session goes on where one ended. A batch of new documents is merge-joined with the runs, matches are verified, the batch is
appended as a run, and ``FAN`` runs of one tier are merged into one of the next.

Not every window is stored. Among the ``WINDOW - GRAM + 1`` hashes of the ``GRAM``-word grams of a window the
least is its anchor, so equal windows have equal anchors, and a run needs only the places of anchors, about a
seventh of all words. Where an anchor matches, the windows around it are made again from the whole texts
on both sides and compared by two independent 64-bit hashes; that verification is exact but for hash collisions
of 128 bits. Only texts that share an anchor are read again. Whole copies of a document are set aside before: all their windows start earlier.

A fingerprint that very many documents share is dealt to files by fingerprint and document, and counted before it is joined, so no task gathers it.
Texts are compressed and dealt by doc_id once, to a bucketed table, so no later step shuffles text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.shared import deleted, exists, new_path, new_table, partitions, small_batches, written

WINDOW = 20
GRAM = 8
FAN = 4
BATCHES = 2
#: How many files the rows of one fingerprint are spread over at most.
SPREAD = 64
ANCHORS = T.ArrayType(T.StructType([T.StructField("fp", T.LongType()), T.StructField("pos", T.IntegerType())]))
ARROW_ANCHORS = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32())]))
WINDOWS = T.ArrayType(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("again", T.BooleanType())]))
ARROW_WINDOWS = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("again", pa.bool_())]))


def compressed(text: Column) -> Column:
    """Length and zstd frame of each text; null is empty."""

    @F.arrow_udf(returnType=T.BinaryType())
    def press(column: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", compression_level=3)
        out = []
        for _, _, data, offs in tw.slices(column):
            raw = data.tobytes()
            out += [int(b - a).to_bytes(8, "little") + codec.compress(raw[a:b], asbytes=True) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return pa.array(out, pa.binary())

    return press(text)


def rows_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of compressed texts of about a megabyte."""
    codec, part, size, first = pa.Codec("zstd"), [], 0, 0
    for i, x in enumerate(column):
        frame = x.as_py() if x.is_valid else bytes(8)
        n = int.from_bytes(frame[:8], "little")
        part.append(codec.decompress(frame[8:], n, asbytes=True) if n else b"")
        size += n
        if size >= tw.SLICE_BYTES or i == len(column) - 1:
            yield first, np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            part, size, first = [], 0, i + 1


def anchor_places(grams: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` successive values stands (the last of equal ones), each place once."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    # the position breaks ties, within the window, so that equal windows choose alike
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    last = span - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(np.arange(len(view)) + last)


def nested(values: list[np.ndarray], counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of structs from the structs' columns and each row's number of them."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    item = kind.value_type
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, item, strict=True)], fields=list(item)))


def anchors(frame: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """``array<struct<fp, pos>>``: the anchors of a text's windows, ``pos`` the index of the gram's first word."""
    span = window - gram + 1

    @F.arrow_udf(returnType=ANCHORS)
    def find(column: pa.Array) -> pa.Array:
        fps, places, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        for _, data, offs in rows_of(column):
            starts, ends, word_offs = tw.word_spans(data, offs)
            words = tw.spans_hash(data, starts, ends, tw.BASES[0])
            first, gram_offs = tw.window_starts(word_offs, gram)
            grams = tw.spans_hash(words, first, first + gram, tw.BASES[0])
            for i in range(len(offs) - 1):
                own = grams[gram_offs[i] : gram_offs[i + 1]]
                at = anchor_places(own, span)
                fps.append(own[at].view(np.int64))
                places.append(at.astype(np.int32))
                counts.append(len(at))
        return nested([np.concatenate(fps), np.concatenate(places)], np.array(counts, np.int64), ARROW_ANCHORS)

    return find(frame)


def windows_at(frame: Column, places: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """``array<struct<h1, h2, start, again>>``: both hashes of every window of a text that holds a gram which starts at one of ``places``; ``again``: whether it also starts earlier there."""

    @F.arrow_udf(returnType=WINDOWS)
    def make(column: pa.Array, at: pa.Array) -> pa.Array:
        near, near_offs = np.asarray(at.flatten(), dtype=np.int64), np.concatenate([[0], np.cumsum(np.asarray(at.value_lengths().fill_null(0), dtype=np.int64))])
        one, two, begin, again, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)], []
        for a, data, offs in rows_of(column):
            starts, ends, word_offs = tw.word_spans(data, offs)
            hashes = [tw.spans_hash(data, starts, ends, base) for base in tw.BASES]
            picked = []
            for i in range(len(offs) - 1):
                n = word_offs[i + 1] - word_offs[i]
                here = near[near_offs[a + i] : near_offs[a + i + 1]]
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, np.maximum(here - (window - gram), 0), 1)
                np.add.at(marks, np.minimum(here + 1, n), -1)
                start = np.flatnonzero(np.cumsum(marks[: max(n - window + 1, 0)]) > 0)
                picked.append(start + word_offs[i])
                begin.append(start.astype(np.int32))
                counts.append(len(start))
            first = np.concatenate(picked)
            for to, words, base in ((one, hashes[0], tw.BASES[0]), (two, hashes[1], tw.BASES[1])):
                to.append(tw.spans_hash(words, first, first + window, base).view(np.int64))
            row = np.repeat(np.arange(len(picked)), [len(x) for x in picked])
            order = np.lexsort((first, two[-1], one[-1], row))
            same = np.zeros(len(order), bool)
            same[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (one[-1], two[-1], row)])
            again.append(same)
        return nested([np.concatenate(x) for x in (one, two, begin, again)], np.array(counts, np.int64), ARROW_WINDOWS)

    return make(frame, places)


KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def kept(frame: Column, starts: Column, copy: Column, window: int = WINDOW) -> Column:
    """``struct<n_words, n_removed, kept_text>``: a text without the words that the windows from ``starts`` cover; of a ``copy``, all windows."""

    @F.arrow_udf(returnType=KEPT)
    def cut(column: pa.Array, removed: pa.Array, whole: pa.Array) -> pa.Array:
        gone, gone_offs = np.asarray(removed.flatten(), dtype=np.int64), np.concatenate([[0], np.cumsum(np.asarray(removed.value_lengths().fill_null(0), dtype=np.int64))])
        n_words, n_removed, texts, whole = [], [], [], np.asarray(whole.fill_null(False))
        for a, data, offs in rows_of(column):
            raw = data.tobytes()
            for i in range(len(offs) - 1):
                words = raw[offs[i] : offs[i + 1]].split()
                here = gone[gone_offs[a + i] : gone_offs[a + i + 1]]
                n_words.append(len(words))
                if whole[a + i] and len(words) >= window:
                    words = []
                elif len(here):
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, here, 1)
                    np.add.at(marks, np.minimum(here + window, len(words)), -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["n_words", "n_removed", "kept_text"])

    return cut(frame, starts, copy)


def bucketed(rows: DataFrame, key: str, buckets: int, name: str) -> str:
    """A table in the shared folder, bucketed by ``key``: joins on it need no shuffle of its rows."""
    table = new_table(rows.sparkSession, name)
    rows.write.bucketBy(buckets, key).option("path", new_path(rows.sparkSession, name)).saveAsTable(table)
    return table


@dataclass(frozen=True)
class Run:
    """Sorted anchors ``(fp, doc_id, pos)`` in a folder; ``level`` counts the merges behind it."""

    path: str
    level: int


class FingerprintLog:
    """Anchors of all documents seen so far, in immutable runs. ``path`` is where an earlier session left a log, or where to begin one."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fan: int = FAN):
        self.spark, self.window, self.gram, self.fan = spark, window, gram, fan
        self.path = path or new_path(spark, "log")
        self.version, self.runs = 0, []
        if exists(spark, f"{self.path}/manifest"):
            rows = spark.read.parquet(f"{self.path}/manifest")
            newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
            if (newest[0]["window"], newest[0]["gram"]) != (window, gram):
                raise ValueError(f"the log at {self.path} has windows of {newest[0]['window']} words and grams of {newest[0]['gram']}")
            self.version, self.runs = newest[0]["version"], [Run(f"{self.path}/{r['name']}", r["level"]) for r in newest if r["name"]]

    def commit(self, runs: list[Run]) -> None:
        """Names ``runs`` as the log in a new version of the manifest, then deletes runs that it no longer names. What dies before leaves the old version valid."""
        self.version += 1
        rows = [(r.path.rsplit("/", 1)[1], r.level, self.window, self.gram) for r in runs] or [(None, 0, self.window, self.gram)]
        self.spark.createDataFrame(rows, "name string, level int, window int, gram int").coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")
        old, self.runs = set(self.runs) - set(runs), runs
        for run in old:
            deleted(self.spark, run.path)

    def write(self, rows: DataFrame, level: int) -> Run:
        run = Run(f"{self.path}/run-{uuid.uuid4().hex[:12]}", level)
        rows.repartition(partitions(rows), "fp", F.pmod("doc_id", F.lit(SPREAD))).sortWithinPartitions("fp").write.parquet(run.path)
        return run

    def read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema("fp long, doc_id long, pos int").parquet(*(r.path for r in runs))

    def append(self, batch: DataFrame) -> Run:
        """The anchors of a batch ``(doc_id, frame)`` as a new run; full tiers are merged."""
        rows = batch.select("doc_id", F.explode(anchors(F.col("frame"), self.window, self.gram)).alias("_a")).select("_a.fp", "doc_id", "_a.pos")
        run = self.write(rows, 0)
        self.commit([*self.runs, run])
        return run

    def compact(self) -> None:
        """Merges the runs of a tier into one of the next while there are ``fan`` of them."""
        while full := [level for level in {r.level for r in self.runs} if sum(r.level == level for r in self.runs) >= self.fan]:
            old = [r for r in self.runs if r.level == full[0]]
            self.commit([*(r for r in self.runs if r not in old), self.write(self.read(old), full[0] + 1)])

    def matches(self, batch: DataFrame) -> DataFrame:
        """``(doc_id, places)``: where the batch's anchors occur again in it or in a run, and where the runs have those anchors.

        Adds the batch to the log.
        """
        self.compact()
        past = self.runs
        new = self.read([self.append(batch)])
        # fingerprints that matter are counted and written first: a join with a table, unlike one with a count, is split where it is skewed
        often = new.groupBy("fp").agg(F.count("*").alias("n"))
        if not past:
            found = new.join(written(often.where("n > 1").select("fp"), "often"), "fp", "left_semi")
        else:
            old = self.read(past)
            both = often.join(old.select("fp").distinct().withColumn("old", F.lit(True)), "fp", "left").where("n > 1 or old").select("fp")
            both = written(both, "often")
            found = new.join(both, "fp", "left_semi").union(old.join(both, "fp", "left_semi"))
        return found.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))

    def deduplicate(self, batch: DataFrame, seen: DataFrame, first: int | None) -> DataFrame:
        """``(doc_id, starts)`` of the batch: its windows whose words also start earlier, in a smaller doc_id or before in the same document.

        ``batch``, ``seen``: (doc_id, frame) of the batch, and of it with all that the log holds; past ids are less
        than ``first``, the least id of the batch. The result is lazy; the log is not.
        """
        texts = seen.join(self.matches(batch), "doc_id")
        made = texts.select("doc_id", F.explode(windows_at(F.col("frame"), F.col("places"), self.window, self.gram)).alias("_w")).select("doc_id", "_w.*")
        made = written(made, "windows")
        least = made.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
        later = made.join(written(least, "least"), ["h1", "h2"], "left").where("again or doc_id > _first")
        if first is not None:
            later = later.where(F.col("doc_id") >= first)
        return later.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, counts: tuple[str, str] | None = ("n_words", "n_removed")) -> DataFrame:
    """``documents`` with, in place of ``text``, the words left, joined by one space, and their numbers before and removed in two columns named by ``counts``.

    Removes each word that is covered by a window of ``window`` words whose sequence also starts earlier: in a smaller
    doc_id, or in the same document at an earlier word. Documents pass through the log in ``batches`` batches in the order of
    doc_id. A null text has no words; a text of fewer words than a window loses none. ``doc_id`` is the key: if an id
    repeats, rows of the same text are one document, and words that one of the rows loses are lost in the others at the same places; rows with a null id
    come back whole. Other columns, whatever their names, come back as they are, but for one named in ``counts``, which is replaced.
    """
    spark = documents.sparkSession
    log, buckets = FingerprintLog(spark, None, window, gram), max(8, partitions(documents))
    rest = [c for c in documents.columns if c != "text"]
    row = F.struct(*(F.col(c) for c in rest)).alias("_row")
    with small_batches(spark):
        whole = documents.select("doc_id", row, F.md5(F.coalesce("text", F.lit(""))).alias("_key"), compressed(F.col("text")).alias("_frame"))
        held = spark.table(bucketed(whole.repartition(buckets, "doc_id"), "doc_id", buckets, "texts"))
        ids = held.where("doc_id is not null").select("doc_id", "_key")
        first_of = written(ids.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "first")
        copies = written(ids.join(first_of, "_key").where("doc_id > _first").select("doc_id").distinct().withColumn("_copy", F.lit(True)), "copies")
        docs = held.where("doc_id is not null").select("doc_id", F.col("_frame").alias("frame")).join(copies, "doc_id", "left_anti")
        cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []))
        found = []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            seen = docs if high is None else docs.where(F.col("doc_id") <= high)
            batch = seen if low is None else seen.where(F.col("doc_id") > low)
            found.append(log.deduplicate(batch, seen, None if low is None else low + 1))
    gone = reduce(DataFrame.union, found).join(copies, "doc_id", "full").withColumnRenamed("doc_id", "_gone")
    done = held.join(gone, held["doc_id"] == gone["_gone"], "left").withColumn("_kept", kept(F.col("_frame"), F.col("starts"), F.col("_copy"), window))
    added = {name: F.col(f"_kept.{kind}").alias(name) for name, kind in zip(counts or (), ("n_words", "n_removed"), strict=False)}
    columns = [F.col("_kept.kept_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns if c not in added]
    return done.select(*columns, *added.values())


def digest(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    done = without_repeats(documents.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
