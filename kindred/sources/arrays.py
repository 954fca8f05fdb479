"""Chunked array stores (the Zarr formats 2 and 3) of labelled matrices, read as tables.

Spark reads the chunks' files, on any storage that it can read, and tasks decode them; the driver reads the small texts that say what arrays there are. A slice names the chunks that it overlaps
before anything is read, so no other file is opened. Arrays of different chunk lengths are lined up in blocks of the longest: each chunk goes to the blocks it overlaps.

A sparse matrix is a table (cell_id, gene_idx, value) here. Its pointers, one a row, meet the blocks of entries that the row lies in, so no task holds more than a block's entries and their rows.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks whose files are looked for one by one; of more, their folder is listed.
FEW = 256
#: The number format's names of codecs inside a Blosc frame, by number; the first is its own.
BLOSC = (None, "lz4_raw", "snappy", "zlib", "zstd")
#: Element types of the third format.
TYPES = {"bool": "|b1", "int8": "|i1", "uint8": "|u1"} | {f"{name}{8 * size}": f"<{name[0]}{size}" for name in ("int", "uint", "float") for size in (2, 4, 8)} | {"string": "|O"}


def unblosc(frame: bytes) -> bytes:
    """The contents of a Blosc frame of version 1 or 2: blocks, each of one stream or one a byte of an element, shuffled by bytes or not."""
    _, _, flags, size, n, block, _ = struct.unpack_from("<4B3I", frame)
    if flags & 2:
        return frame[16 : 16 + n]
    if flags & 4 or not BLOSC[min(flags >> 5, 4)]:
        raise ValueError("a Blosc frame with shuffled bits, or of the codec blosclz, can't be read")
    codec, out = BLOSC[flags >> 5], []
    for k in range(-(-n // block)):
        at, whole = struct.unpack_from("<I", frame, 16 + 4 * k)[0], min(block, n - k * block)
        streams = 1 if flags & 16 or whole < block or size <= 1 else size
        parts = []
        for _ in range(streams):
            (length,) = struct.unpack_from("<I", frame, at)
            part, at = frame[at + 4 : at + 4 + length], at + 4 + length
            if length < whole // streams:
                part = zlib.decompress(part) if codec == "zlib" else pa.decompress(part, whole // streams, codec, asbytes=True)
            parts.append(part)
        data = b"".join(parts)
        if flags & 1 and size > 1:
            even = len(data) // size * size
            data = np.frombuffer(data[:even], np.uint8).reshape(size, -1).T.tobytes() + data[even:]
        out.append(data)
    return b"".join(out)


def _unpacked(data: bytes, codec: str) -> bytes:
    if codec == "blosc":
        return unblosc(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "bz2":
        return bz2.decompress(data)
    if codec == "lzma":
        return lzma.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "lz4":
        return pa.decompress(data[4:], struct.unpack_from("<i", data)[0], "lz4_raw", asbytes=True)
    raise ValueError(f"chunks packed by {codec} can't be read")


@dataclass
class Array:
    """What a store says of one array: its shape, that of its chunks, its elements, how they are packed, and how chunks are named."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: list[str]
    fill: object = None
    order: str = "C"
    prefix: str = ""
    separator: str = "."

    @classmethod
    def of(cls, path: str, about: dict) -> Array:
        if about.get("zarr_format", 2) == 3:
            kind, packed = about["data_type"], []
            if not isinstance(kind, str) or kind not in TYPES:
                raise ValueError(f"elements of type {kind} can't be read")
            dtype = TYPES[kind]
            for codec in about["codecs"]:
                if codec["name"] == "bytes":
                    dtype = dtype.replace("<", ">") if codec.get("configuration", {}).get("endian") == "big" else dtype
                elif codec["name"] not in ("vlen-utf8", "crc32c"):
                    packed.append(codec["name"])
                elif codec["name"] == "crc32c":
                    raise ValueError("chunks with checksums can't be read")
            keys = about.get("chunk_key_encoding", {"name": "default"})
            plain = keys["name"] == "default"
            separator = keys.get("configuration", {}).get("separator", "/" if plain else ".")
            return cls(path, tuple(about["shape"]), tuple(about["chunk_grid"]["configuration"]["chunk_shape"]), dtype, packed, about.get("fill_value"), "C", f"c{separator}" if plain else "", separator)
        filters = [x["id"] for x in about.get("filters") or []]
        if set(filters) - {"vlen-utf8"}:
            raise ValueError(f"the filters {filters} can't be undone")
        packed = [about["compressor"]["id"]] if about.get("compressor") else []
        return cls(path, tuple(about["shape"]), tuple(about["chunks"]), about["dtype"], packed, about.get("fill_value"), about.get("order", "C"), "", about.get("dimension_separator", "."))

    def key(self, *chunk: int) -> str:
        return self.prefix + self.separator.join(map(str, chunk))

    @property
    def counts(self) -> tuple[int, ...]:
        """How many chunks there are along each axis."""
        return tuple(-(-n // max(c, 1)) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def kind(self) -> str:
        return {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}.get(np.dtype(self.dtype).kind, "string")

    def decoded(self, content: bytes | None) -> np.ndarray:
        """A chunk's elements, of the chunk's whole shape; of the fill value where there is no file."""
        n = int(np.prod(self.chunks))
        if content is None:
            fill = (self.fill if self.fill is not None else "") if self.kind == "string" else float(self.fill or 0)
            return np.full(self.chunks, fill, object if self.kind == "string" else np.dtype(self.dtype))
        for codec in reversed(self.codecs):
            content = _unpacked(content, codec)
        if np.dtype(self.dtype).kind == "O":
            out, at = np.empty(n, object), 4
            out[:] = ""
            for i in range(struct.unpack_from("<I", content)[0]):
                (length,) = struct.unpack_from("<I", content, at)
                out[i], at = content[at + 4 : at + 4 + length].decode(), at + 4 + length
            return out.reshape(self.chunks)
        return np.frombuffer(content, self.dtype, n).reshape(self.chunks, order=self.order)


def _arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "string":
        return pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in values.tolist()], pa.string())
    return pa.array(values.astype({"boolean": bool, "bigint": np.int64, "double": np.float64}[kind]))


def _assembled(array: Array, pieces: list[dict], start: int, end: int) -> np.ndarray:
    """The elements ``start`` to ``end`` of an array of one axis, from the chunks that overlap them."""
    held = {p["chunk"]: p["content"] for p in pieces}
    size = array.chunks[0]
    parts = [array.decoded(held.get(k))[max(start - k * size, 0) : end - k * size] for k in range(start // size, -(-end // size))]
    return np.concatenate(parts) if parts else np.zeros(0)


@dataclass
class Node:
    attrs: dict
    array: Array | None = None


@dataclass
class ArrayStore:
    """A labelled matrix in a store at ``path``: its matrix, layers, and what is said of its rows (obs) and columns (var)."""

    spark: SparkSession
    path: str
    _nodes: dict[str, Node | None] = field(default_factory=dict)

    # what there is

    def _hadoop(self, name: str) -> tuple[object, object]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}".rstrip("/"))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _text(self, name: str) -> dict | None:
        system, where = self._hadoop(name)
        if not system.exists(where):
            return None
        stream = system.open(where)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def node(self, name: str) -> Node | None:
        """A group or an array by its path in the store; None if it isn't there."""
        if name not in self._nodes:
            at = f"{name}/" if name else ""
            third = self._text(f"{at}zarr.json")
            about = third or self._text(f"{at}.zarray") or self._text(f"{at}.zgroup")
            attrs = (third or {}).get("attributes", {}) if third else self._text(f"{at}.zattrs") or {}
            full = f"{self.path.rstrip('/')}/{name}".rstrip("/")
            self._nodes[name] = None if about is None else Node(attrs, Array.of(full, about) if "shape" in about else None)
        return self._nodes[name]

    def array(self, name: str) -> Array:
        node = self.node(name)
        if node is None or node.array is None:
            raise ValueError(f"there is no array {name} in the store")
        return node.array

    def names(self, name: str = "") -> list[str]:
        """What a group holds, in order."""
        system, where = self._hadoop(name)
        if not system.exists(where):
            return []
        found = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
        return sorted(n for n in found if self.node(f"{name}/{n}" if name else n) is not None)

    @property
    def shape(self) -> tuple[int, int] | None:
        return self.shape_of("X") if self.node("X") else None

    def shape_of(self, group: str) -> tuple[int, int]:
        node = self.node(group)
        return tuple(node.array.shape if node.array else node.attrs["shape"])

    def info(self) -> dict[str, object]:
        """The names of columns, layers and unstructured entries, and the matrix's shape; of what the store has."""
        out: dict[str, object] = {g: self.names(g) for g in ("obs", "var", "layers", "uns") if self.node(g)}
        return out | ({"shape": self.shape} if self.shape else {})

    # chunks

    def _files(self, array: Array, wanted: list[tuple[int, ...]]) -> DataFrame:
        """``(c0, ..., content)`` of those chunks of an array that have files, and of no others."""
        where = lambda chunk: f"{array.path}/{array.key(*chunk)}"
        axes = len(array.shape)
        schema = ", ".join([*(f"c{i} long" for i in range(axes)), "content binary"])
        if len(wanted) <= FEW:
            system, _ = self._hadoop("")
            there = [where(c) for c in wanted if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where(c)))]
        else:
            folder = f"{array.path}/{array.prefix}".rstrip("./")
            system, _ = self._hadoop("")
            listed = system.listFiles(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
            names = set()
            while listed.hasNext():
                names.add(listed.next().getPath().toUri().getPath())
            own = lambda path: self.spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
            root = own(array.path)
            there = [where(c) for c in wanted if f"{root}/{array.key(*c)}" in names]
        if not there:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.format("binaryFile").load(there)
        pattern = r"[./]".join([r"([0-9]+)"] * axes) + "$"
        return read.select(*(F.regexp_extract("path", pattern, i + 1).cast("long").alias(f"c{i}") for i in range(axes)), "content")

    def _blocks(self, arrays: dict[str, Array], start: int, end: int) -> tuple[DataFrame, int]:
        """(``(block, pieces)``, length of a block): for each block that overlaps ``start`` to ``end`` the chunks of all arrays of one axis, ``pieces`` of (name, chunk, content); a block without a file has none."""
        size = max(1, *(a.chunks[0] for a in arrays.values()))
        blocks = self.spark.range(start // size, -(-end // size)).select(F.col("id").alias("block"))
        parts = None
        for name, a in arrays.items():
            own = a.chunks[0]
            wanted = [(k,) for k in range(start // own, -(-end // own))]
            files = self._files(a, wanted).select(F.explode(F.sequence(F.floor(F.col("c0") * own / size), F.floor((F.col("c0") * own + own - 1) / size))).alias("block"), F.struct(F.lit(name).alias("name"), F.col("c0").alias("chunk"), "content").alias("piece"))
            parts = files if parts is None else parts.union(files)
        held = parts.groupBy("block").agg(F.collect_list("piece").alias("pieces"))
        return blocks.join(held, "block", "left").select("block", F.coalesce("pieces", F.array().cast(held.schema["pieces"].dataType)).alias("pieces")), size

    def _columns(self, arrays: dict[str, Array], start: int, end: int) -> DataFrame:
        """``(row, *names)`` of arrays of one axis and equal length, side by side."""
        blocks, size = self._blocks(arrays, start, end)
        schema = ", ".join(["row long", *(f"`{n}` {a.kind}" for n, a in arrays.items())])

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, pieces in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    low, high, held = max(start, block * size), min(end, (block + 1) * size), pieces.as_py()
                    columns = [_arrow(_assembled(a, [p for p in held if p["name"] == n], low, high), a.kind) for n, a in arrays.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *columns], ["row", *arrays])

        return blocks.mapInArrow(decode, schema)

    # labels of rows and columns

    def values(self, name: str, start: int = 0, end: int | None = None) -> DataFrame | None:
        """``(row, value)`` of an array of one axis, or a part of it; None if it isn't there."""
        if self.node(name) is None:
            return None
        array = self.array(name)
        return self._columns({"value": array}, start, array.shape[0] if end is None else min(end, array.shape[0]))

    def uns(self, key: str) -> DataFrame | None:
        return self.values(f"uns/{key}")

    def index(self, group: str = "obs") -> DataFrame:
        """``(row, value)``: the names of the rows, or of the columns."""
        return self.values(f"{group}/{self.node(group).attrs['_index']}")

    def column(self, group: str, name: str) -> DataFrame | None:
        """``(row, value)`` of one column of obs or var; None if it isn't there."""
        if self.node(f"{group}/{name}") is None:
            return None
        return self.annotations(group, [name]).select("row", F.col(name).alias("value"))

    def annotations(self, group: str = "obs", columns: list[str] | None = None, start: int = 0, end: int | None = None) -> DataFrame:
        """``(row, *columns)`` of obs or var, or of some of its rows. Categories stand for their codes, in either layout; a negative code is null, and so is what a mask hides."""
        chosen = [c for c in self.names(group) if not c.startswith("__")] if columns is None else columns
        arrays, dictionaries, masks = {}, {}, []
        for c in chosen:
            node = self.node(f"{group}/{c}")
            if node is None:
                raise ValueError(f"{group} has no column {c}")
            if node.array is not None:
                arrays[c] = node.array
                # the older layout names the categories beside the codes
                if "categories" in node.attrs:
                    dictionaries[c] = f"{group}/{node.attrs['categories']}"
            elif self.node(f"{group}/{c}/categories"):
                arrays[c], dictionaries[c] = self.array(f"{group}/{c}/codes"), f"{group}/{c}/categories"
            else:
                arrays[c], arrays[f"{c}\0mask"] = self.array(f"{group}/{c}/values"), self.array(f"{group}/{c}/mask")
                masks.append(c)
        if not arrays:
            raise ValueError(f"{group} has no columns")
        most = next(iter(arrays.values())).shape[0]
        plain = {f"c{i}": a for i, a in enumerate(arrays.values())}
        place = {n: f"c{i}" for i, n in enumerate(arrays)}
        out = self._columns(plain, start, most if end is None else min(end, most))
        for c in masks:
            out = out.withColumn(place[c], F.when(~F.col(place[f"{c}\0mask"]), F.col(place[c])))
        for c, name in dictionaries.items():
            words = self.values(name).select(F.col("row").alias("_code"), F.col("value").alias(f"_{place[c]}"))
            out = out.join(words, F.col(place[c]) == F.col("_code"), "left").drop("_code", place[c]).withColumnRenamed(f"_{place[c]}", place[c])
        return out.select("row", *(F.col(place[c]).alias(c) for c in chosen))

    # matrices

    def matrix(self, group: str = "X", cells: tuple[int, int] | None = None, genes: tuple[int, int] | None = None) -> DataFrame:
        """``(cell_id, gene_idx, value)``: the entries of a matrix, or of a range of its cells, of its genes, or both.

        By rows (csr) a range of cells reads the chunks it lies in alone; by columns (csc) a range of genes does. Ranges along the other axis, and of a list of coordinates (coo), filter what is
        read; of a dense matrix, whose zeros are left out, both ranges name chunks.
        """
        node = self.node(group)
        if node is None:
            raise ValueError(f"there is no matrix {group} in the store")
        shape = self.shape_of(group)
        limits = {"cell_id": cells or (0, shape[0]), "gene_idx": genes or (0, shape[1])}
        limits = {axis: (max(0, a), min(b, n)) for (axis, (a, b)), n in zip(limits.items(), shape, strict=True)}
        kind = "array" if node.array else node.attrs.get("encoding-type")
        if kind == "array":
            out = self._dense(node.array, *limits.values())
        elif kind == "coo_matrix":
            named = {name: self.array(f"{group}/{c}") for name, c in (("cell_id", "row"), ("gene_idx", "col"), ("value", "data"))}
            out = self._columns(named, 0, named["value"].shape[0]).drop("row")
        elif kind in ("csr_matrix", "csc_matrix"):
            major, minor = ("cell_id", "gene_idx") if kind == "csr_matrix" else ("gene_idx", "cell_id")
            out = self._compressed(group, major, minor, *limits[major])
        else:
            raise ValueError(f"matrices of the encoding {kind} can't be read")
        for axis, (a, b) in limits.items():
            out = out.where((F.col(axis) >= a) & (F.col(axis) < b))
        return out.select("cell_id", "gene_idx", F.col("value").cast("double").alias("value"))

    def _compressed(self, group: str, major: str, minor: str, start: int, end: int) -> DataFrame:
        pointers, arrays = self.array(f"{group}/indptr"), {"data": self.array(f"{group}/data"), "indices": self.array(f"{group}/indices")}
        schema = f"{major} long, {minor} long, value double"
        if start >= end:
            return self.spark.createDataFrame([], schema)
        held = self._columns({"at": pointers}, start, end + 1)
        first, last = held.agg(F.min("at"), F.max("at")).first()
        if first >= last:
            return self.spark.createDataFrame([], schema)
        blocks, size = self._blocks(arrays, first, last)
        both = held.select("row", F.col("at").alias("_from"), F.lit(None).cast("long").alias("_to")).union(held.select(F.col("row") - 1, F.lit(None).cast("long"), "at"))
        rows = both.groupBy("row").agg(F.max("_from").alias("_from"), F.max("_to").alias("_to")).where("_from < _to")
        lying = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
        lying = lying.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.greatest("_from", F.col("block") * size).alias("a"), F.least("_to", (F.col("block") + 1) * size).alias("b"), "row"))).alias("rows"))

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pieces, lines in zip(batch.column(0), batch.column(1), strict=True):
                    held, own = pieces.as_py(), lines.values
                    a, b, row = (own.field(c).to_numpy() for c in ("a", "b", "row"))
                    # a block's rows lie one behind the other
                    value, other = (_assembled(arrays[n], [p for p in held if p["name"] == n], int(a[0]), int(b[-1])) for n in ("data", "indices"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, b - a)), pa.array(other.astype(np.int64)), pa.array(value.astype(np.float64))], [major, minor, "value"])

        return blocks.join(lying, "block").select("pieces", "rows").mapInArrow(decode, schema)

    def _dense(self, array: Array, cells: tuple[int, int], genes: tuple[int, int]) -> DataFrame:
        (a, b), (c, d), (high, wide) = cells, genes, array.chunks
        wanted = [(i, j) for i in range(a // high, -(-b // high)) for j in range(c // wide, -(-d // wide))]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    # elements behind the matrix's edge are of no meaning
                    block = array.decoded(content)[: array.shape[0] - i * high, : array.shape[1] - j * wide]
                    row, column = np.nonzero(block)
                    yield pa.RecordBatch.from_arrays([pa.array(row + i * high), pa.array(column + j * wide), pa.array(block[row, column].astype(np.float64))], ["cell_id", "gene_idx", "value"])

        return self._files(array, wanted).mapInArrow(decode, "cell_id long, gene_idx long, value double")
