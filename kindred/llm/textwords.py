"""Vectorised words and rolling hashes over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo 2**64
evaluated with prefix sums, so a hash of any run of words costs two look-ups, and every
task computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Odd bases of two independent hash families.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SLICE_BYTES = 1 << 19

SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of letters and digits; every byte of a character beyond ASCII counts as one.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.uint64]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.uint64]:
    """base**0 ... base**N for some N >= n, and base**-N, all modulo 2**64."""
    table, inverse = _powers.get(base, (None, None))
    if table is None or len(table) <= n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size + 1, base & MASK, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        inverse = np.uint64(pow(pow(base, -1, 1 << 64), size, 1 << 64))
        _powers[base] = (table, inverse)
    return table, inverse


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run values[start:end]; equal runs have equal hashes wherever they stand."""
    n = len(values)
    table, inverse = powers(base, n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * table[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * table[len(table) - 1 - starts] * inverse)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row stands alone and whole."""
    data, offs = buffer_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, side="right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all runs of bytes that ``table`` marks, and each row's offsets into them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = table[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with the capitals of ASCII and Latin-1 made small."""
    out = LOWER[data]
    if len(out) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    return out


def window_starts(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Global indices of words at which a window of k words of one row starts, and each row's offsets into them."""
    counts = np.maximum(np.diff(word_offs) - (k - 1), 0)
    offs = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(offs[-1]) + np.repeat(word_offs[:-1] - offs[:-1], counts)
    return starts, offs


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row with row offsets. A row of 1 to k-1 words has one shingle: all its words."""
    starts, ends, word_offs = word_spans(data, offs)
    words = spans_hash(data, starts, ends, base)
    counts = np.diff(word_offs)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(out[-1]) + np.repeat(word_offs[:-1] - out[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    return spans_hash(words, first, first + length, base), out
