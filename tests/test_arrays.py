"""Chunked stores against what was written to them: layouts, codecs, slices and what files they open."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from kindred.sources import arrays


def blosc(data: bytes, size: int, codec: str, block: int, shuffle: bool = True, split: bool = True) -> bytes:
    """A frame as the format's description has it."""
    starts, out, base = [], b"", 16 + 4 * -(-len(data) // block)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        if shuffle:
            even = len(part) // size * size
            part = np.frombuffer(part[:even], np.uint8).reshape(-1, size).T.tobytes() + part[even:]
        streams = size if split and len(part) == block else 1
        starts.append(base + len(out))
        for k in range(streams):
            own = part[k * len(part) // streams : (k + 1) * len(part) // streams]
            packed = zlib.compress(own) if codec == "zlib" else pa.compress(own, codec, asbytes=True)
            packed = own if len(packed) >= len(own) else packed
            out += struct.pack("<I", len(packed)) + packed
    number = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    head = struct.pack("<4B3I", 2, 1, (1 if shuffle else 0) | (0 if split else 16) | number << 5, size, len(data), block, base + len(out))
    return head + b"".join(struct.pack("<I", s) for s in starts) + out


def put(path: Path, content: bytes | dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(json.dumps(content).encode() if isinstance(content, dict) else content)


def pack(data: bytes, codec: str | None, size: int) -> bytes:
    if codec == "blosc":
        return blosc(data, size, "lz4_raw", 64 * size)
    return {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec](data)


def text(values) -> bytes:
    return struct.pack("<I", len(values)) + b"".join(struct.pack("<I", len(v.encode())) + v.encode() for v in values)


def write(path: Path, x: np.ndarray, chunks, codec="zlib", version=2, attrs=None, skip=()):
    """An array as one of the formats has it; chunks in ``skip`` are left out, as are those of nothing but the fill value."""
    words = x.dtype.kind in "OU"
    dtype = "|O" if words else x.dtype.str
    if version == 2:
        put(path / ".zarray", {"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": dtype, "compressor": codec and {"id": codec}, "filters": [{"id": "vlen-utf8"}] if words else None, "fill_value": "" if words else 0, "order": "C"})
        put(path / ".zattrs", attrs or {})
    else:
        codecs = [{"name": "vlen-utf8"} if words else {"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
        kind = "string" if words else x.dtype.name
        put(path / "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": x.shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": codecs, "fill_value": "" if words else 0, "attributes": attrs or {}})
    for at in np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunks, strict=True))):
        part = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        if at in skip:
            continue
        if words:
            raw = text(part.tolist())
        else:
            full = np.zeros(chunks, x.dtype)
            full[tuple(map(slice, part.shape))] = part
            raw = full.tobytes()
        put(path / (".".join(map(str, at)) if version == 2 else "c/" + "/".join(map(str, at))), pack(raw, codec, x.dtype.itemsize))


def group(path: Path, version=2, **attrs):
    if version == 2:
        put(path / ".zgroup", {"zarr_format": 2})
        put(path / ".zattrs", attrs)
    else:
        put(path / "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": attrs})


def sparse(path: Path, dense: np.ndarray, encoding: str, chunk: int, version=2, codec="zlib", other_chunk=None):
    by = dense if encoding == "csr_matrix" else dense.T
    row, col = np.nonzero(by)
    group(path, version, **{"encoding-type": encoding, "shape": list(dense.shape)})
    if encoding == "coo_matrix":
        row, col = np.nonzero(dense)
        for name, x in (("row", row.astype(np.int32)), ("col", col.astype(np.int32)), ("data", dense[row, col])):
            write(path / name, x, [chunk], codec, version)
        return
    write(path / "data", by[row, col], [chunk], codec, version)
    write(path / "indices", col.astype(np.int32), [other_chunk or chunk], codec, version)
    write(path / "indptr", np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(by)))]).astype(np.int32), [37], codec, version)


N, M = 120, 30


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(0)
    x = np.where(rng.random((N, M)) < 0.2, rng.integers(1, 50, (N, M)), 0).astype(np.float32)
    x[[3, 4, 70]] = 0
    x[5] = 7
    return x


@pytest.fixture(scope="module", params=[(2, "blosc"), (2, None), (3, "zstd")], ids=str)
def store(request, tmp_path_factory, dense, spark):
    version, codec = request.param
    root = tmp_path_factory.mktemp("store")
    group(root, version)
    sparse(root / "X", dense, "csr_matrix", 50, version, codec, other_chunk=32)
    group(root / "layers", version)
    sparse(root / "layers/by_gene", dense, "csc_matrix", 40, version, codec)
    sparse(root / "layers/listed", dense, "coo_matrix", 64, version, codec)
    write(root / "layers/dense", dense, [50, 8], codec, version)
    for name, n in (("obs", N), ("var", M)):
        group(root / name, version, _index="names", **{"column-order": []})
        write(root / name / "names", np.array([f"{name}é{i}" for i in range(n)], object), [33], codec, version)
        write(root / name / "count", np.arange(n, dtype=np.int64) * 3, [50], codec, version)
        write(root / name / "share", np.linspace(0, 1, n), [20], codec, version)
        write(root / name / "good", np.arange(n) % 3 == 0, [50], codec, version)
        group(root / name / "kind", version, **{"encoding-type": "categorical", "ordered": False})
        write(root / name / "kind/codes", (np.arange(n) % 4 - 1).astype(np.int8), [50], codec, version)
        write(root / name / "kind/categories", np.array(["a", "b", "c"], object), [3], codec, version)
        group(root / name / "maybe", version, **{"encoding-type": "nullable-integer"})
        write(root / name / "maybe/values", np.arange(n, dtype=np.int32), [50], codec, version)
        write(root / name / "maybe/mask", np.arange(n) % 5 == 0, [50], codec, version)
    group(root / "uns", version)
    write(root / "uns/genes", np.array(["x", "y"], object), [2], codec, version)
    return arrays.ArrayStore(spark, str(root))


def entries(df):
    return sorted((r.cell_id, r.gene_idx, r.value) for r in df.collect())


def wanted(dense, cells=(0, N), genes=(0, M)):
    row, col = np.nonzero(dense)
    return [(int(i), int(j), float(dense[i, j])) for i, j in zip(row, col, strict=True) if cells[0] <= i < cells[1] and genes[0] <= j < genes[1]]


def test_what_there_is(store):
    info = store.info()
    assert info["shape"] == (N, M) and info["layers"] == ["by_gene", "dense", "listed"] and info["uns"] == ["genes"]
    assert info["obs"] == ["count", "good", "kind", "maybe", "names", "share"]
    assert store.node("nothing") is None and store.names("nothing") == [] and store.uns("nothing") is None and store.column("obs", "nothing") is None
    assert [r.value for r in store.uns("genes").orderBy("row").collect()] == ["x", "y"]
    assert [r.value for r in store.index("var").orderBy("row").collect()] == [f"varé{i}" for i in range(M)]


def test_annotations(store):
    for group_name, n in (("obs", N), ("var", M)):
        got = store.annotations(group_name).orderBy("row").collect()
        assert [r.row for r in got] == list(range(n)) and [r["count"] for r in got] == [3 * i for i in range(n)]
        assert [r.good for r in got] == [i % 3 == 0 for i in range(n)] and np.allclose([r.share for r in got], np.linspace(0, 1, n))
        assert [r.kind for r in got] == [[None, "a", "b", "c"][i % 4] for i in range(n)]
        assert [r.maybe for r in got] == [None if i % 5 == 0 else i for i in range(n)]
    part = store.annotations("obs", ["names", "kind"], 48, 53).orderBy("row").collect()
    assert [(r.row, r.names, r.kind) for r in part] == [(i, f"obsé{i}", [None, "a", "b", "c"][i % 4]) for i in range(48, 53)]
    assert [r.value for r in store.column("obs", "kind").orderBy("row").take(3)] == [None, "a", "b"]
    with pytest.raises(ValueError):
        store.annotations("obs", ["nothing"])


@pytest.mark.parametrize("name", ["X", "layers/by_gene", "layers/listed", "layers/dense"])
def test_matrices(store, dense, name):
    assert store.shape_of(name) == (N, M)
    assert entries(store.matrix(name)) == wanted(dense)
    for cells, genes in (((3, 6), None), ((0, 70), (25, 99)), ((4, 4), None)) if name in ("X", "layers/by_gene") else (((60, 110), (7, 9)),):
        assert entries(store.matrix(name, cells, genes)) == wanted(dense, cells or (0, N), genes or (0, M))


def read_files(df, part):
    return sorted(f.rsplit(part, 1)[1].strip("/").removeprefix("c/") for f in df.inputFiles() if part in f)


def test_slices_open_the_chunks_they_lie_in(store, dense):
    before, own = int((dense[:60] != 0).sum()), int((dense[60] != 0).sum())
    one = store.matrix("X", (60, 61))
    assert read_files(one, "X/data") == [str(k) for k in range(before // 50, -(-(before + own) // 50))]
    assert read_files(one, "X/indices") == [str(k) for k in range(before // 32, -(-(before + own) // 32))]
    assert read_files(one, "X/indptr") == ["1"]
    gene = store.matrix("layers/by_gene", genes=(3, 4))
    assert len(read_files(gene, "by_gene/data")) <= 2 < len(read_files(store.matrix("layers/by_gene"), "by_gene/data"))
    assert len(read_files(store.matrix("layers/dense", (10, 20), (9, 10)), "layers/dense")) == 1
    assert read_files(store.annotations("obs", ["share"], 25, 30), "obs/share") == ["1"]


def test_many_chunks_are_listed(store, dense, monkeypatch):
    monkeypatch.setattr(arrays, "FEW", 1)
    assert entries(store.matrix("X")) == wanted(dense) and entries(store.matrix("layers/dense")) == wanted(dense)


def test_older_categories_missing_chunks_and_refusals(spark, tmp_path):
    group(tmp_path)
    group(tmp_path / "obs", _index="kind")
    write(tmp_path / "obs/kind", np.array([1, 0, -1, 1], np.int8), [2], attrs={"categories": "__categories/kind"})
    write(tmp_path / "obs/__categories/kind", np.array(["a", "b"], object), [2])
    write(tmp_path / "obs/gap", np.arange(6, dtype=np.int32)[:4] + 1, [2], skip={(1,)})
    write(tmp_path / "obs/none", np.arange(4, dtype=np.float32), [2], skip={(0,), (1,)})
    store = arrays.ArrayStore(spark, str(tmp_path))
    got = store.annotations("obs", ["kind", "gap", "none"]).orderBy("row").collect()
    assert [(r.kind, r.gap, r.none) for r in got] == [("b", 1, 0.0), ("a", 2, 0.0), (None, 0, 0.0), ("b", 0, 0.0)]
    assert store.shape is None and store.info() == {"obs": ["gap", "kind", "none"]}
    group(tmp_path / "odd", **{"encoding-type": "bsr_matrix", "shape": [2, 2]})
    for what in (lambda: store.matrix("odd"), lambda: store.matrix("X"), lambda: store.array("obs"), lambda: arrays._unpacked(b"", "other")):
        with pytest.raises(ValueError):
            what()


@pytest.mark.parametrize("codec", ["lz4_raw", "snappy", "zlib", "zstd"])
def test_blosc_frames(codec):
    rng = np.random.default_rng(1)
    for x in (np.arange(1000, dtype=np.int32), rng.random(333), np.frombuffer(rng.bytes(700), np.uint8), np.zeros(5000, np.int16)):
        for shuffle in (True, False):
            for split in (True, False):
                assert arrays.unblosc(blosc(x.tobytes(), x.itemsize, codec, 64 * x.itemsize, shuffle, split)) == x.tobytes()
    stored = struct.pack("<4B3I", 2, 1, 2, 4, 8, 8, 24) + b"abcdefgh"
    assert arrays.unblosc(stored) == b"abcdefgh"
    with pytest.raises(ValueError):
        arrays.unblosc(struct.pack("<4B3I", 2, 1, 0, 4, 8, 8, 24) + b"abcdefgh")
