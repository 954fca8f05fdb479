"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets decide.

1. Texts that are equal are one class; only classes go on.
2. A signature of ``bands * rows`` minima is cut into bands; texts that agree on a band are
   candidates. With 44 bands of 8 rows a pair of similarity 0.8 is missed with probability
   (1 - 0.8**8)**44 = 0.0003.
3. The bands are shuffled as pairs of 64-bit numbers. Bands of one text go; the others become stars (see ``stars``), so that a
   full shingle set moves once or a few times, not once a band, and chains of texts that share no band don't meet. A star of more than
   ``block`` texts is dealt to pairs of blocks, so no task ever gathers it.
4. A task counts the partners of each text (a number, not the pairs) and keeps a spanning forest
   of the links; the components of the forests are the classes' groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.components import components
from kindred.llm.shared import order_text, ordered_number, small_batches, written
from kindred.llm.stars import BLOCK, stars, verified

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 44, 8
#: Marks of wanted texts, 64 bits each, that are broadcast at most; more are joined by a shuffle of all texts.
FEW = 2_000_000
#: Shingles that are hashed side by side.
CHUNK = 512


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def band_keys(shingles: np.ndarray, offs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(document, band) keys of the minima of each document's shingles; documents without shingles have no meaning here."""
    factors = multipliers(bands * rows)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    sig = np.full((len(offs) - 1, bands * rows), 0xFFFFFFFF, np.uint32)
    for i in range(len(offs) - 1):
        for at in range(offs[i], offs[i + 1], CHUNK):
            part = short[at : min(at + CHUNK, offs[i + 1]), None] * factors
            np.minimum(sig[i], part.min(0), out=sig[i])
    mix = tw.mixed(np.arange(1, rows + 1, dtype=np.uint64))
    keys = (sig.reshape(-1, bands, rows).astype(np.uint64) * mix).sum(-1, dtype=np.uint64)
    return tw.mixed(keys + np.arange(bands, dtype=np.uint64) * np.uint64(tw.BASES[1]))


def banded(texts: Column, bands: int, rows: int) -> Column:
    """The band keys of each text; none for a text without words."""

    @F.arrow_udf(returnType=T.ArrayType(T.LongType()))
    def keys(column: pa.Array) -> pa.Array:
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offs in tw.slices(column):
            hashes, at = tw.shingles(data, offs, SHINGLE)
            found = band_keys(hashes, at, bands, rows).view(np.int64)
            has = np.diff(at) > 0
            values.append(found[has].ravel())
            counts.append(has * bands)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))

    return keys(texts)


def shingle_set(texts: Column) -> Column:
    """The distinct shingle hashes of each text, sorted, as little-endian bytes."""

    @F.arrow_udf(returnType=T.BinaryType())
    def sets(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offs in tw.slices(column):
            hashes, at = tw.shingles(data, offs, SHINGLE)
            out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, pa.binary())

    return sets(texts)


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix: whose sets have at least this Jaccard similarity. Equal sets always do; empty ones never."""
    sizes = np.array([len(x) for x in left + right], dtype=np.float64)
    both = np.concatenate(left + right)
    who = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
    values, place, count = np.unique(both, return_inverse=True, return_counts=True)
    common = count[place] > 1
    who, place = who[common], place[common]
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    n = len(left)
    shared = np.zeros((n, len(right)), np.float32)
    width = max(256, (1 << 22) // len(sizes))
    ids = np.cumsum(np.concatenate([[True], place[1:] != place[:-1]])) - 1 if len(place) else place
    total = int(ids[-1]) + 1 if len(ids) else 0
    cuts = np.searchsorted(ids, np.arange(0, total + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            block = np.zeros((len(sizes), width), np.float32)
            block[who[a:b], ids[a:b] - k * width] = 1
            shared += block[:n] @ block[n:].T
    union = sizes[:n, None] + sizes[None, n:] - shared
    return (shared > 0) & (shared >= similarity * union - 1e-6)


def linking(similarity: float) -> Callable[[list[bytes], list[bytes] | None], np.ndarray]:
    """Which of the shingle sets, as bytes, link."""

    def link(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        one = [np.frombuffer(x, np.uint64) for x in left]
        return linked(one, one if right is None else [np.frombuffer(x, np.uint64) for x in right], similarity)

    return link


def jaccard_links(documents: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(text_key, rep, copies, words, partners, component, component_id)`` of each class of equal texts: its least doc_id, its rows, whether it has words, the rows of the
    classes it links to, the least class that links reach and the least doc_id that they reach (the last three null where there are none)."""
    with small_batches(documents.sparkSession):
        return _jaccard_links(documents, similarity, bands, rows, block)


def _jaccard_links(documents: DataFrame, similarity: float, bands: int, rows: int, block: int) -> DataFrame:
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.md5("text").alias("text_key"), banded(F.col("text"), bands, rows).alias("keys"))
    classes = keyed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max(F.size("keys") > 0).alias("words"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.xxhash64("text_key")), "classes")
    pairs = stars(classes.select(F.explode("keys").alias("key"), "node"))
    wanted = classes.join(pairs.select("node").distinct(), "node", "left_semi").select("text_key", "rep", "node", "copies")
    if pairs.select("node").distinct().count() <= FEW:
        # few enough to tell every task which rows are wanted, so that other texts are not shuffled
        mark = wanted.select(F.xxhash64("node", "rep").alias("mark"))
        docs = docs.join(F.broadcast(mark), F.xxhash64(F.xxhash64(F.md5("text")), "doc_id") == F.col("mark"), "left_semi")
    own = F.md5(docs["text"]) == wanted["text_key"]
    texts = docs.join(wanted, own & docs["doc_id"].eqNullSafe(wanted["rep"])).dropDuplicates(["text_key"])
    # names sort by the least doc_id, so the least name of a component says which document that is
    name = F.concat(order_text(F.col("rep")), "text_key").alias("name")
    content = texts.select("node", "copies", name, shingle_set(F.col("text")).alias("raw"))
    found = written(verified(pairs, content, linking(similarity), block), "links")
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    key = lambda c: F.substring(c, 17, 32)
    groups = components(found.where("node <> root"), "node", "root").select(key("node").alias("text_key"), key("component").alias("component"), ordered_number(F.col("component")).alias("component_id"))
    of = classes.select("text_key", "rep", "copies", "words").join(partners.select(key("node").alias("text_key"), "partners"), "text_key", "left")
    # written, so that its join with documents is split where one text has very many copies
    return written(of.join(groups, "text_key", "left"), "groups")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_links, component_id, kept)``: one row per row of ``documents``.

    ``n_links``: other documents whose sets of five-word shingles have Jaccard similarity of at
    least ``similarity``, equal texts included. ``component_id``: the least doc_id reachable by
    links. ``kept``: whether that is the document itself. A text of one to four words has one
    shingle; a null text, or one without words, links with nothing. A repeated row counts as a copy; rows that share an id
    but not a text are documents of their own; rows with a null id are returned, and link, but name no component.
    """
    of_class = jaccard_links(documents, similarity, bands, rows, block)
    joined = documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key")).join(of_class, "text_key")
    links = F.when(F.col("words"), F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    component = F.when(F.col("words"), F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", links.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near-duplicates one row, of the least doc_id; columns, whatever their names, as they are.

    Rows without words or without an id stay. Of texts of one group that share that least id the one with the least hash stays.
    """
    names = documents.columns
    of_class = jaccard_links(documents, similarity).where("words").withColumn("group", F.coalesce("component", "text_key"))
    first = F.col("rep") == F.coalesce("component_id", "rep")
    best = of_class.where(first).groupBy("group").agg(F.min(F.struct("text_key", "rep")).alias("_b")).select(F.col("_b.text_key").alias("_key"), F.col("_b.rep").alias("_id"))
    nested = documents.select(F.struct(*(F.col(c) for c in names)).alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    judged = F.col("words") & F.col("id").isNotNull()
    chosen = nested.where(judged).join(best, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    repeated = chosen.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select("id", "key")
    once = chosen.join(repeated, ["id", "key"], "left_anti").select("row").union(chosen.join(repeated, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("row"))
    return once.union(nested.where(~judged).select("row")).select("row.*")
