"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A filter is a direction; a vector belongs to it if their inner product exceeds a bound. The directions
of one table are all concatenations of a code word of the first half and one of the second half of a randomly
rotated space, so ``code**2`` of them are decoded from ``2 * code`` inner products: for each word of the first half that can still
exceed the bound, the words of the second half that do. ``TABLES`` independent rotations keep the number of a vector's filters even.
The code grows with the square root of the number of vectors, so that a filter holds few vectors that aren't near at any size of the table. Two
vectors at cosine 0.98 share no filter with a probability below 0.005 (0.0025 was measured at the largest code); every pair that shares one is verified exactly.

Equal vectors are one class. Filters are joined as pairs of 64-bit numbers; vectors that are alone in all their filters go, and only then the others'
components move, to the stars of their filters (see ``stars``), dealt to pairs of blocks, so a frequent
filter is no hot group. A task counts partners and keeps a spanning forest; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.components import components
from kindred.llm.shared import order_text, ordered_number, written
from kindred.llm.stars import BLOCK, stars, verified

COSINE = 0.98
TABLES = 24
#: Code words of a half at least and at most.
LEAST_CODE, MOST_CODE = 32, 2048
#: Filters of a table that a vector exceeds, on average over uniform directions.
WANTED = 1.0
#: A cap reaches so far from its direction at least, as a cosine; in few dimensions the mean number alone would make caps narrower than links.
REACH = 0.85


@lru_cache(maxsize=8)
def tables(dim: int, n_tables: int, code: int, wanted: float) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
    """Of each table the rotation and the code words of both halves; the bound, as the quantile that lets ``wanted`` filters pass."""
    rng, half, out = np.random.default_rng(98), dim // 2, []
    for _ in range(n_tables):
        words = [code_words(rng, code, n) for n in (half, dim - half)]
        out.append(tuple(x.astype(np.float32) for x in (np.linalg.qr(rng.normal(size=(dim, dim)))[0], *words)))
    # the bound is the quantile of random directions' sums that lets ``wanted`` filters pass on average; those are sums of the largest parts
    probe = rng.normal(size=(4096, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    largest = lambda x: -np.sort(-x, axis=1)[:, :32]
    sums = np.concatenate([(largest(a)[:, :, None] + largest(b)[:, None, :]).ravel() for a, b in (half_sums(probe, t) for t in out[:2])])
    nth = max(len(sums) - int(2 * wanted * len(probe)), 0)
    return out, min(float(np.partition(sums, nth)[nth]), REACH * 2**0.5)


def code_words(rng: np.random.Generator, code: int, dim: int) -> np.ndarray:
    """Unit vectors, ``code`` of them but in the fewest dimensions; in one there are but two."""
    if dim == 1:
        return np.array([[1.0], [-1.0]])
    words = rng.normal(size=(min(code, 2 * 4 ** (dim - 1)), dim))
    return words / np.linalg.norm(words, axis=1, keepdims=True)


def half_sums(unit: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, word) inner products of both halves, in single precision as they only choose candidates; a filter's is the sum of two, but for a common factor."""
    unit = unit.astype(np.float32)
    turned, half = unit @ table[0], table[1].shape[1]
    return turned[:, :half] @ table[1].T, turned[:, half:] @ table[2].T


def decoded(unit: np.ndarray, n_tables: int, code: int, wanted: float) -> list[np.ndarray]:
    """The filters of each vector, ascending. In fewer than two dimensions there is one filter for all."""
    n, dim = unit.shape
    if dim < 2:
        return [np.zeros(1, np.int32)] * n
    made, bound = tables(dim, n_tables, code, wanted)
    who, ids = [], []
    for k, table in enumerate(made):
        first, second = half_sums(unit, table)
        row, word = np.nonzero(first > bound - second.max(1, keepdims=True))
        at, other = np.nonzero(second[row] > bound - first[row, word][:, None])
        who.append(row[at])
        ids.append((k * code * code + word[at] * code + other).astype(np.int32))
    who, ids = np.concatenate(who), np.concatenate(ids)
    order = np.lexsort((ids, who))
    return np.split(ids[order], np.searchsorted(who[order], np.arange(1, n)))


FOUND = T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("filters", T.ArrayType(T.IntegerType()))])


def described(vector: Column, single: bool, n_tables: int, code: int, wanted: float) -> Column:
    """``struct<raw, dim, filters>`` of each vector; all null if it is null, empty, zero or holds a null or non-finite component."""
    kind = np.dtype(np.float32 if single else np.float64)

    @F.arrow_udf(returnType=FOUND)
    def describe(column: pa.Array) -> pa.Array:
        n = len(column)
        raw, dims, filters = [None] * n, np.zeros(n, np.int32), [None] * n
        lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        values = column.flatten()
        broken = np.asarray(values.is_null()) | ~np.isfinite(np.asarray(values.fill_null(0), dtype=kind))
        flat = np.asarray(values.fill_null(0), dtype=kind)
        ends = np.cumsum(lengths)
        bad = np.concatenate([[0], np.cumsum(broken)])
        for dim in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == dim)
            rows = rows[bad[ends[rows]] == bad[ends[rows] - dim]]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                vectors = flat[(ends[part] - dim)[:, None] + np.arange(dim)] + kind.type(0)
                norm = np.linalg.norm(vectors.astype(np.float64), axis=1)
                part, vectors, norm = part[norm > 0], vectors[norm > 0], norm[norm > 0]
                for i, v, f in zip(part, vectors, decoded(vectors.astype(np.float64) / norm[:, None], n_tables, code, wanted), strict=True):
                    raw[i], dims[i], filters[i] = v.tobytes(), dim, f
        return pa.StructArray.from_arrays([pa.array(raw, pa.binary()), pa.array(dims), pa.array(filters, pa.list_(pa.int32()))], ["raw", "dim", "filters"])

    return describe(vector)


def linking(cosine: float, single: bool) -> Callable[[list[bytes], list[bytes] | None], np.ndarray]:
    """Which vectors, as bytes of one length each, link."""
    kind = np.float32 if single else np.float64

    def unit(raw: list[bytes]) -> np.ndarray:
        vectors = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
        return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]

    def link(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        one = unit(left)
        return one @ (one if right is None else unit(right)).T >= cosine

    return link


def code_for(vectors: int) -> int:
    """Code words of a half: the least power of 2 whose square is the number of vectors, within the limits."""
    return int(min(max(1 << ((max(vectors, 1) - 1).bit_length() + 1) // 2, LEAST_CODE), MOST_CODE))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, n_tables: int = TABLES, code: int | None = None, wanted: float = WANTED, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label, not null, link if their cosine in double precision is at least ``cosine``. ``n_links``: other vectors
    linked directly, equal ones included; ``component_id``: the least vec_id reachable by links; ``kept``: whether that is the
    row's own. Null, empty and zero vectors, those with null or non-finite components, of unequal lengths and with a null label link with
    nothing. A repeated row counts as a copy; rows that share an id but not a vector are vectors of their own; a row with a null id comes back with no component.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    single = isinstance(kind, T.FloatType)
    cast = F.col("embedding").cast("array<float>" if single else "array<double>")
    code = code or code_for(vectors.count())
    base = vectors.select("vec_id", F.col("label").cast("string").alias("label"), described(cast, single, n_tables, code, wanted).alias("_v")).select("vec_id", "label", "_v.*")
    whole = F.col("raw").isNotNull() & F.col("label").isNotNull()
    base = written(base.withColumn("name", F.when(whole, F.md5(F.concat("raw", F.encode("label", "utf-8"))))), "vectors")
    fine = base.where("name is not null and vec_id is not null")
    classes = fine.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.xxhash64("name")), "classes")
    # of each class the filters of one row: its least id's
    chosen = fine.join(classes.select("name", F.col("rep").alias("vec_id"), "node", "copies"), ["name", "vec_id"])
    pairs = stars(chosen.select("label", "dim", "node", F.explode("filters").alias("filter")).select(F.xxhash64("label", "dim", "filter").alias("key"), "node").distinct())
    content = chosen.join(pairs.select("node").distinct(), "node", "left_semi").dropDuplicates(["name"])
    # full names sort by the least vec_id, so the least one of a component says which vector that is
    content = content.select("node", "copies", F.concat(order_text(F.col("vec_id")), "name").alias("name"), "raw")
    found = written(verified(pairs, content, linking(cosine, single), block), "links")
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    key = lambda c: F.substring(c, 17, 32)
    groups = components(found.where("node <> root"), "node", "root").select(key("node").alias("name"), ordered_number(F.col("component")).alias("_component"))
    of_class = classes.join(partners.select(key("node").alias("name"), "partners"), "name", "left").join(groups, "name", "left").select("name", "rep", "copies", "partners", "_component")
    joined = base.select("vec_id", "name").join(written(of_class, "groups"), "name", "left")
    links = F.when(F.col("vec_id").isNull() | F.col("copies").isNull(), F.lit(0)).otherwise(F.coalesce("partners", F.lit(0)) + F.col("copies") - 1)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_component", "rep", "vec_id"))
    return joined.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
