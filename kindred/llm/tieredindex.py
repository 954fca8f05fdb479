"""Ranked lexical search, exact, over a tiered index.

Documents are dealt to shards of about ``SHARD`` postings. In a shard each term's postings are ordered by impact and cut into tiers, the highest first, and every term
has, for each tier, a residual bound: the highest impact in the tiers below. A shard also keeps its documents' own terms, so a candidate is scored
in full without touching any list.

An item first meets the first tier of all shards. What its terms' residual bounds add up to is the most that a document can reach that
no posting has shown yet: if that is less than the k-th best score known, and every document shown that may reach that score has been
scored, the shard's answer is proven. The k-th best score over all shards is then found, and items and shards that lack proof against it fall through: only their shards' lower tiers are
read, and they descend tier by tier until proof, at the latest where nothing is left below. So results are exact, whatever the tiers are.

The impact of a posting is the document's part of the score; a term's weight multiplies it when an item asks, so an index doesn't depend on items. For a given set of items the index
may be restricted to their terms: a bitmap of ``BITS`` bits, whatever the number of terms, tells in the first pass over the texts which words can be among them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import new_path, partitions, small_batches, written
from kindred.llm.termwords import pieces, raw_texts

TOP = 10
#: Postings of a shard, on average.
SHARD = 1 << 20
#: Where a list's tiers end, as shares of its length; the first holds ``LEAST`` postings at least, so rare terms are whole there.
TIERS, LEAST = (1 / 16, 1 / 4, 1.0), 64
#: Bits that tell which words may be among those of the items.
BITS = 1 << 20
#: Documents scored in full for a first threshold in a shard.
TRIED = 64
#: Units of a posting's impact, and what its length is weighed with.
UNIT, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75

COUNTED = T.StructType([T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
ARROW_COUNTED = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("tfs", pa.list_(pa.int64()))])


def counted(text: Column, bits: object = None) -> Column:
    """``struct<n, terms, tfs>``: the number of words of a text, and its distinct ones with their counts; with ``bits``, a broadcast bitmap, only terms whose bit is set."""

    @F.arrow_udf(returnType=COUNTED)
    def count(column: pa.Array) -> pa.Array:
        keep = None if bits is None else bits.value
        lengths, terms, tfs, ends = [], [], [], [0]
        for raw in raw_texts(column):
            found: Counter = Counter()
            for words in pieces(raw):
                found.update(words)
            lengths.append(found.total())
            if keep is not None:
                found = {w: n for w, n in found.items() if keep[zlib.crc32(w) % BITS]}
            terms += found.keys()
            tfs += found.values()
            ends.append(len(terms))
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.binary()), (tfs, pa.int64()))]
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), *lists], fields=list(ARROW_COUNTED))

    return count(text)


def bitmap(terms: DataFrame) -> bytes:
    """One byte for each of ``BITS`` places: whether a term (term) has it. At most so many numbers come to the driver, however many terms there are."""
    places = terms.select(F.pmod(F.crc32("term"), F.lit(BITS)).cast("int").alias("place")).distinct().toArrow()["place"].to_numpy()
    out = np.zeros(BITS, np.uint8)
    out[places] = 1
    return out.tobytes()


RECORD = pa.schema([("shard", pa.int32()), ("tier", pa.int32()), ("terms", pa.list_(pa.binary())), *((c, pa.binary()) for c in ("ids", "doc_offs", "doc_terms", "doc_impacts", "offs", "rows", "impacts", "rest"))])
RECORD_DDL = "shard int, tier int, terms array<binary>, ids binary, doc_offs binary, doc_terms binary, doc_impacts binary, offs binary, rows binary, impacts binary, rest binary"


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight: saturating in it, less in longer documents."""
    length = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(words, 1)
    return (UNIT * tf) // (1000 * tf + SATURATION * length)


def records(shard: int, ids: np.ndarray, lengths: np.ndarray, terms: pa.Array, tf: np.ndarray, sizes: np.ndarray, documents: int, words: int) -> Iterator[pa.RecordBatch]:
    """A shard's index, one record a tier. Postings come by documents: ``sizes`` of them for each of ``ids``."""
    coded = terms.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary
    row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    impact = impacts_of(tf, lengths[row], documents, words)
    order = np.lexsort((-impact, code))
    by_term = np.bincount(code, minlength=len(names))
    begin = np.concatenate([[0], np.cumsum(by_term)])
    place = np.arange(len(order)) - np.repeat(begin[:-1], by_term)
    ends = [np.minimum(np.maximum(np.ceil(by_term * share).astype(np.int64), LEAST), by_term) for share in TIERS]
    row, sorted_impact, code = row[order], impact[order].astype(np.int32), code[order]
    tier = sum((place >= end[code]).astype(np.int8) for end in ends)
    for t, end in enumerate(ends):
        here = np.flatnonzero(tier == t)
        offs = np.concatenate([[0], np.cumsum(np.bincount(code[here], minlength=len(names)))]).astype(np.int64)
        more = end < by_term
        rest = np.zeros(len(names), np.int64)
        rest[more] = sorted_impact[(begin[:-1] + end)[more]]
        own = [ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), coded.indices.to_numpy().astype(np.int32), impact.astype(np.int32)] if t == 0 else [None] * 4
        blobs = [None if x is None else x.tobytes() for x in (*own, offs, row[here], sorted_impact[here], rest)]
        listed = pa.array([names if t == 0 else None], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([t], pa.int32()), listed, *(pa.array([x], pa.binary()) for x in blobs)], schema=RECORD)


def indexed(batches: Iterator[pa.RecordBatch], documents: int, words: int) -> Iterator[pa.RecordBatch]:
    """Batches (shard, doc_id, n, terms, tfs), sorted by shard, to the records of their shards."""
    current, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = whole["terms"].combine_chunks(), whole["tfs"].combine_chunks()
        sizes = np.asarray(terms.value_lengths(), dtype=np.int64)
        yield from records(current, whole["doc_id"].to_numpy().astype(np.int64), whole["n"].to_numpy().astype(np.int64), terms.flatten(), np.asarray(tfs.flatten()), sizes, documents, words)

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


@dataclass
class Tier:
    offs: np.ndarray
    rows: np.ndarray
    impacts: np.ndarray
    rest: np.ndarray


@dataclass
class Shard:
    """A shard's index in memory: as many tiers as were read. ``touched``: postings read from lists and from documents, of ``full`` in the lists of the items asked."""

    places: dict[bytes, int] = field(default_factory=dict)
    ids: np.ndarray | None = None
    doc_offs: np.ndarray | None = None
    doc_terms: np.ndarray | None = None
    doc_impacts: np.ndarray | None = None
    tiers: list[Tier] = field(default_factory=list)
    touched: int = 0
    full: int = 0

    def add(self, record: dict) -> None:
        """Records of a shard come in the order of their tiers."""
        if record["tier"] == 0:
            self.places = {bytes(t): i for i, t in enumerate(record["terms"])}
            self.ids, self.doc_offs = np.frombuffer(record["ids"], np.int64), np.frombuffer(record["doc_offs"], np.int64)
            self.doc_terms, self.doc_impacts = np.frombuffer(record["doc_terms"], np.int32), np.frombuffer(record["doc_impacts"], np.int32)
        self.tiers.append(Tier(*(np.frombuffer(record[c], kind) for c, kind in (("offs", np.int64), ("rows", np.int32), ("impacts", np.int32), ("rest", np.int64)))))

    def scores(self, rows: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, from their own terms."""
        by_code = np.zeros(len(self.places), np.int64)
        by_code[codes] = weights
        begin, size = self.doc_offs[rows], self.doc_offs[rows + 1] - self.doc_offs[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        self.touched += len(at)
        sums = np.concatenate([[0], np.cumsum(by_code[self.doc_terms[at]] * self.doc_impacts[at])])
        return sums[ends] - sums[ends - size]

    def top(self, terms: list[bytes], weights: list[int], least: int, k: int) -> tuple[bool, int, np.ndarray, np.ndarray]:
        """(proven, most, ids, scores): up to k of the best documents with whole scores above 0; of equal scores the smaller ids.

        ``least``: the k-th best score known so far. If ``proven``, no document but those returned can be among the k best with that score or more; else ``most`` is
        what another one may reach.
        """
        known = [(self.places[t], w) for t, w in zip(terms, weights, strict=True) if t in self.places]
        if not known:
            return True, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, weight = np.array([c for c, _ in known]), np.array([w for _, w in known], np.int64)
        upper, best, score, most = np.zeros(len(self.ids)), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for depth, tier in enumerate(self.tiers):
            bound = int((tier.rest[codes] * weight).sum())
            upper[:] = bound
            for above in self.tiers[: depth + 1]:
                begin, size = above.offs[codes], above.offs[codes + 1] - above.offs[codes]
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
                # what a posting adds to a document's bound: its part instead of the most that is left below
                gain = (above.impacts[at] - np.repeat(tier.rest[codes], size)) * np.repeat(weight, size)
                upper += np.bincount(above.rows[at], gain, minlength=len(self.ids))
            self.touched += int(ends[-1])
            tried = np.argpartition(-upper, TRIED)[:TRIED] if len(upper) > TRIED else np.arange(len(upper))
            best, score = self.best(tried, self.scores(tried, codes, weight), k)
            reach = max(least, 1, int(score[-1]) if len(score) == k else 0)
            # bounds are sums of integers in doubles: what is lost beyond 2**53 is allowed for
            rest = np.flatnonzero(upper >= reach * (1 - 1e-9) - 0.5)
            if bound < reach:
                best, score = self.best(rest, self.scores(rest, codes, weight), k)
                self.full += int(sum(t.offs[codes + 1].sum() - t.offs[codes].sum() for t in self.tiers))
                return True, 0, self.ids[best], score
            most = int(upper.max()) + 1
        return False, most, self.ids[best], score

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= cut], score[score >= cut]
        rows, score = rows[score > 0], score[score > 0]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


FOUND = pa.schema([("item", pa.int64()), ("shard", pa.int32()), ("proven", pa.bool_()), ("most", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "item long, shard int, proven boolean, most long, doc_id long, score long"


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches of a shard's records and then of the items that ask it, sorted so. An item without proof that found nothing has a row with a null id."""
    current, shard = None, Shard()
    for batch in batches:
        out: list[tuple] = []
        for i in range(len(batch)):
            record = {c: batch.column(c)[i] for c in batch.schema.names}
            if record["shard"].as_py() != current:
                current, shard = record["shard"].as_py(), Shard()
            if not record["asks"].as_py():
                values = {c: x.as_buffer() for c, x in record.items() if pa.types.is_binary(x.type) and x.is_valid}
                shard.add(values | {"tier": record["tier"].as_py(), "terms": record["terms"].as_py()})
                continue
            proven, most, ids, scores = shard.top(record["terms"].as_py(), record["weights"].as_py(), record["least"].as_py(), k)
            item = record["item"].as_py()
            out += [(item, current, proven, most, d, s) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
            if not proven and not len(ids):
                out.append((item, current, proven, most, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND)


class TieredIndex:
    """Records of shards in a folder, one of its parts a tier; with the number of documents that have words, of all their words, and each term's number of documents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.documents, self.words, self.shards = about["documents"], about["words"], about["shards"]

    @classmethod
    def build(cls, documents: DataFrame, terms: DataFrame | None = None, path: str | None = None, shard: int = SHARD) -> TieredIndex:
        """An index of ``documents`` (doc_id, text); with ``terms`` (term, binary) of these alone, and of what words share their bits. Statistics are of all words in any case."""
        spark, path = documents.sparkSession, path or new_path(documents.sparkSession, "tiers")
        bits = None if terms is None else spark.sparkContext.broadcast(bitmap(terms))
        with small_batches(spark):
            found = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), counted(F.col("text"), bits).alias("_c"))
            held = written(found.select("doc_id", "_c.*").where("n > 0"), "counted")
            sizes = held.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
            n, words, shards = sizes["documents"], sizes["words"], max(1, -(-sizes["postings"] // shard))
            held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
            dealt = held.where(F.size("terms") > 0).select(F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n", "terms", "tfs")
            dealt = dealt.repartition(max(partitions(documents), min(shards, 10_000)), "shard").sortWithinPartitions("shard")

            def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return indexed(batches, n, words)

            dealt.mapInArrow(index, RECORD_DDL).write.partitionBy("tier").parquet(f"{path}/tiers")
        spark.createDataFrame([(n, words, shards)], "documents long, words long, shards long").write.parquet(f"{path}/about")
        return cls(spark, path)

    def tiers(self) -> DataFrame:
        return self.spark.read.schema(RECORD_DDL).parquet(f"{self.path}/tiers")

    def weighted(self, items: DataFrame) -> DataFrame:
        """``(item, terms, weights)`` of items (item, terms, tfs): their terms that weigh anything, by how rare they are and how often the item has them."""
        rarity = F.floor(1000 * F.log((2 * F.lit(self.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
        pairs = items.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("item", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf"))
        known = pairs.join(self.spark.read.parquet(f"{self.path}/terms"), "term").withColumn("weight", rarity * F.col("tf")).where("weight > 0")
        grouped = known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_t"))
        return grouped.select("item", F.col("_t.term").alias("terms"), F.col("_t.weight").alias("weights"))

    def _asked(self, tiers: DataFrame, asks: DataFrame, k: int, name: str) -> DataFrame:
        """``asks``: (shard, item, terms, weights, least), met with the records of their shards."""
        records = [c for c in RECORD.names if c != "terms"]
        own = tiers.select(F.lit(False).alias("asks"), "terms", *records, *(F.lit(None).cast(kind).alias(c) for c, kind in (("item", "long"), ("weights", "array<long>"), ("least", "long"))))
        other = asks.select(F.lit(True).alias("asks"), "terms", "shard", *(F.lit(None).cast(tiers.schema[c].dataType).alias(c) for c in records[1:]), "item", "weights", "least")
        both = own.unionByName(other).repartition(max(partitions(asks), min(self.shards, 10_000)), "shard").sortWithinPartitions("shard", "asks", "tier", "item")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return searched(batches, k)

        with small_batches(self.spark, 16):
            return written(both.mapInArrow(search, FOUND_DDL), name)

    def top(self, items: DataFrame, k: int = TOP) -> DataFrame:
        """``(item, rank, doc_id, score)``: the k best documents of each item (item, terms, tfs), ``item`` a distinct number."""
        asked = written(self.weighted(items), "asked")
        everywhere = asked.select("item", "terms", "weights", F.lit(0).cast("long").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard")).withColumn("shard", F.col("shard").cast("int"))
        first = self._asked(self.tiers().where("tier = 0"), everywhere, k, "first")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        hits = first.where("doc_id is not null")
        least = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        open_pairs = first.where("not proven").groupBy("item", "shard").agg(F.max("most").alias("most"))
        lacking = open_pairs.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).where("most >= least")
        lacking = written(lacking.join(asked, "item").select("shard", "item", "terms", "weights", "least"), "lacking")
        if not lacking.isEmpty():
            below = self.tiers().join(lacking.select("shard").distinct(), "shard", "left_semi")
            second = self._asked(below, lacking, k, "second")
            hits = hits.join(lacking.select("item", "shard"), ["item", "shard"], "left_anti").unionByName(second.where("doc_id is not null").select(hits.columns))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, shard: int = SHARD) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item (item_id, text) its k best documents (doc_id, text) with a score above 0, ties by ascending doc_id.

    Whole texts of both are read; null and empty ones have no terms. Every row is a document, or an item, of its own: a repeated row counts, and is ranked, as often as it
    occurs. Documents with a null id take no part. Items without terms, or whose terms no document has, have no rows; an item's id may be null or of any type. Other columns aren't read.
    """
    spark = documents.sparkSession
    with small_batches(spark):
        asked = written(items.select("item_id", counted(F.col("text")).alias("_c")).select("item_id", "_c.terms", "_c.tfs"), "items")
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "numbered")
    index = TieredIndex.build(documents, asked.select(F.explode("terms").alias("term")), shard=shard)
    return index.top(asked.select("item", "terms", "tfs"), k).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
