"""Best-fit packing by exact complements.

Only the histogram of piece lengths (at most ``SIZE`` numbers) decides how sequences are composed,
so the plan is made from 4096 counts whatever the size of the corpus, and holds a bounded number
of compositions. Spark then ranks the pieces of each length, in buckets so that a frequent length is
no hot group, and a look-up turns rank into sequence and offset.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw
from kindred.llm.shared import partitions, small_batches, written

SIZE = 4096
END = 1
#: Words and ids of words that a task keeps at most.
SLOTS, HELD = 1 << 20, 1 << 23
STOPS = ".,;:!?"
#: Pieces of one length in one bucket, on average at most.
PER_BUCKET = 200_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words, one after another. The ids of words seen before stand in a table of ``SLOTS`` slots by the words' hashes, whose
    later words replace earlier ones, and is emptied when ``HELD`` ids are in it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self.keys, self.first, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.held, self.filled = np.zeros(HELD, np.uint32), 0

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has.

        Words of letters, or letters and one stop, go through the tokenizer side by side: they are one or two runs, and the last
        id of a run is marked as such. Where the number of marks is another than that, and for other words, each goes alone.
        """
        texts = [w.decode() for w in words]
        runs = np.array([1 if w.isalpha() else 2 if w[-1] in STOPS and w[:-1].isalpha() else 0 for w in texts], dtype=np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        alone, simple = [np.flatnonzero(runs == 0)], np.flatnonzero(runs)
        for at in range(0, len(simple), 4096):
            part = simple[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends, marks = np.cumsum(runs[part]), np.flatnonzero(self.last[ids]) + 1
            if len(marks) == ends[-1] and marks[-1] == len(ids):
                for i, x in zip(part, np.split(ids, marks[ends[:-1] - 1]), strict=True):
                    found[i] = x
            else:
                alone.append(part)
        rest = np.concatenate(alone)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype=np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of UTF-8 bytes, and each row's offsets into them."""
        starts, ends, word_offs = tw.word_spans(data, offs)
        names, example, place = np.unique(tw.spans_hash(data, starts, ends, tw.BASES[0]), return_index=True, return_inverse=True)
        slot = (names & np.uint64(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != names)
        raw = data.tobytes()
        found, sizes = self.tokens([raw[starts[i] : ends[i]] for i in example[new]])
        base = self.filled
        if base + len(found) > len(self.held):
            old = np.setdiff1d(np.arange(len(names)), new, assume_unique=True)
            found = np.concatenate([ragged(self.held, self.first[slot[old]], self.size[slot[old]]), found])
            sizes, new, base = np.concatenate([self.size[slot[old]], sizes]), np.concatenate([old, new]), 0
            self.keys[:] = 0
            self.held = np.zeros(max(HELD, len(found)), np.uint32)
        self.held[base : base + len(found)] = found
        self.filled = base + len(found)
        first, size = self.first[slot], self.size[slot]
        first[new], size[new] = base + np.cumsum(sizes) - sizes, sizes
        self.keys[slot], self.first[slot], self.size[slot] = names, first, size
        n_ids = size[place]
        return ragged(self.held, first[place], n_ids), np.concatenate([[0], np.cumsum(n_ids)])[word_offs]


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[first : first + size], one after another."""
    return values[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


@cache
def encoder(path: str) -> WordEncoder:
    """One a process: what a task has learned serves the next ones."""
    return WordEncoder(path)


def pieces_of(ids: bytes, size: int = SIZE) -> list[dict]:
    """The pieces of one document's ids: only one of more than ``size`` ids is cut."""
    step = 4 * size
    return [{"piece": k, "start": k * size, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, part in enumerate(ids[at : at + step] for at in range(0, len(ids), step))]


PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
ARROW_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def tokenized(text: Column, path: str, size: int = SIZE) -> Column:
    """The pieces of each text's ids, with id 1 at its end; a null text is empty."""

    @F.arrow_udf(returnType=PIECES)
    def cut(column: pa.Array) -> pa.Array:
        machine, out = encoder(path), []
        for _, _, data, offs in tw.slices(column):
            ids, at = machine.encode(data, offs)
            out += [pieces_of(ids[a:b].astype("<u4").tobytes() + END.to_bytes(4, "little"), size) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, ARROW_PIECES)

    return cut(text)


@dataclass
class Plan:
    """For each length the ranks at which a composition begins, with its first sequence and the place in it."""

    first: np.ndarray  # of each length, into the other arrays
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.rank + (np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 44)
        at = np.searchsorted(key, rank + (length << 44), side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


class Complements:
    """Which gaps one, two or three of the lengths that are left fill exactly. ``left`` is changed by who uses the index, and only falls between renewals."""

    def __init__(self, left: np.ndarray):
        self.left, self.size = left, len(left) - 1
        self.renew()

    def renew(self) -> None:
        """Indexes the sums of two and of three lengths by convolution; a length that is left once is no pair with itself."""
        has = (self.left > 0).astype(np.float64)
        width = 1 << (3 * self.size).bit_length()
        spectrum = np.fft.rfft(has, width)
        pairs = np.fft.irfft(spectrum * spectrum, width)[: self.size + 1]
        once = np.flatnonzero(self.left == 1)
        once = once[2 * once <= self.size]
        pairs[2 * once] -= 1
        self.pairs = pairs > 0.5
        self.triples = np.fft.irfft(spectrum * np.fft.rfft(self.pairs.astype(np.float64), width), width)[: self.size + 1] > 0.5

    def pair(self, gap: int) -> list[int] | None:
        low = np.arange(1, gap // 2 + 1)
        good = (self.left[low] > 0) & (self.left[gap - low] > 0)
        if gap % 2 == 0 and len(good):
            good[-1] = self.left[gap // 2] > 1
        return [gap - int(low[good.argmax()]), int(low[good.argmax()])] if good.any() else None

    def find(self, gap: int) -> list[int] | None:
        """Up to three lengths that fill the gap exactly, if there are such: all indexed candidates are tried."""
        if self.left[gap] > 0:
            return [gap]
        if self.pairs[gap] and (found := self.pair(gap)):
            return found
        if not self.triples[gap]:
            return None
        most = np.flatnonzero(self.left[: gap - 1] > 0)[::-1]
        for a in most[self.pairs[gap - most]]:
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return [int(a), *rest]
        return None


def compose(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of compositions that use every piece once. ``counts[n]``: the pieces of length n.

    From the longest piece on, a sequence is filled exactly by one, two or three lengths if there
    are such; else it takes the longest piece that fits, the best fit, and tries again. A composition is
    repeated as often as its lengths last, so each uses up a length, but for a rest smaller than it needs, and their number stays within a few times ``size``.
    """
    counts, out = counts.astype(np.int64).copy(), []
    index = Complements(counts.copy())
    while len(rest := np.flatnonzero(counts)):
        index.left[:] = counts
        index.renew()
        lengths, gap = [], size
        found: list[int] | None = [int(rest[-1])]
        while found:
            for x in found:
                index.left[x] -= 1
            lengths += found
            gap -= sum(found)
            found = None
            if gap > 0 and not (found := index.find(gap)):
                fit = np.flatnonzero(index.left[: gap + 1])
                found = [int(fit[-1])] if len(fit) else None
        used = {x: lengths.count(x) for x in set(lengths)}
        times = min(int(counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
        out.append((times, lengths))
    return out


def plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    rank, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    for times, lengths in compose(counts, size):
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(np.searchsorted(table[:, 0], np.arange(size + 2)), table[:, 1], table[:, 2], table[:, 3], sequence)


def placed(pieces: DataFrame, size: int, make: Callable[[np.ndarray, int], Plan] = plan) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length").count().collect()
    counts = np.zeros(size + 1, np.int64)
    for length, n in sizes:
        counts[length] = n
    made = spark.sparkContext.broadcast(make(counts, size))
    buckets = int(max(8, -(-int(counts.max(initial=0)) // PER_BUCKET)))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n")).select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_rank", nth - 1).join(starts, ["length", "_b"])

    @F.arrow_udf(returnType=T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = made.value.place(np.asarray(length, dtype=np.int64), np.asarray(rank, dtype=np.int64))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    found = ranked.withColumn("_at", look_up(F.col("length"), F.col("_rank") + F.col("_start")))
    return found.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def packed(documents: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: one row per piece of each document.

    A null or empty text is the one id 1. Repeated rows and null ids are packed like any others;
    an empty table gives no rows.
    """
    cut = documents.select("doc_id", F.explode(tokenized(F.col("text"), path or tokenizer_path(), size)).alias("_p")).select("doc_id", "_p.*")
    with small_batches(documents.sparkSession):
        pieces = written(cut, "pieces")
    return placed(pieces, size)
