"""Volumes as tables of chunks: NPY, raw and uncompressed TIFF files, read where they lie.

A chunk row: vol, z0, y0, x0, nz, ny, nx, dtype, data (C order, little endian). Files come as binary rows, so any store that Spark reads will do."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "vol string, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"


def parse_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def write_npy(volume: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(volume), allow_pickle=False)
    return out.getvalue()


def parse_npz(data: bytes, names: Sequence[str] | None = None) -> dict[str, np.ndarray]:
    """The arrays of a bundle; names: exactly these must be there. Objects are refused."""
    with np.load(io.BytesIO(data), allow_pickle=False) as bundle:
        if names is not None and sorted(names) != sorted(bundle.files):
            raise ValueError(f"arrays are {sorted(bundle.files)}, not {sorted(names)}")
        return {name: bundle[name] for name in sorted(bundle.files)}


def read_bundles(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(path, name, shape, dtype, data) of every array of NPZ files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for where, content in zip(rows["path"], rows["content"], strict=True):
                made = [(where, name, list(a.shape), a.dtype.newbyteorder("<").str, a.astype(a.dtype.newbyteorder("<")).tobytes()) for name, a in parse_npz(content, names).items()]
                yield pd.DataFrame(made, columns=["path", "name", "shape", "dtype", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, shape array<long>, dtype string, data binary")


def cropped(cells: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Voxels (z, y, x, ...) of the half-open box, with coordinates from its corner."""
    inside = F.lit(True)
    for c, lo, hi in zip("zyx", low, high, strict=True):
        inside = inside & (F.col(c) >= lo) & (F.col(c) < hi)
    out = cells.filter(inside)
    for c, lo in zip("zyx", low, strict=True):
        out = out.withColumn(c, F.col(c) - lo)
    return out


def plane(cells: DataFrame, axis: str, at: int) -> DataFrame:
    """The voxels of one slice, without its axis."""
    return cells.filter(F.col(axis) == at).drop(axis)


def merged_channels(cells: DataFrame, channel: str, names: Sequence[str], value: str = "v") -> DataFrame:
    """One row for each voxel with a column for each channel 0, 1, ...; null where a channel has no value. The other way round: `split_channels`."""
    return cells.groupBy(*[c for c in cells.columns if c not in (channel, value)]).agg(*[F.max(F.when(F.col(channel) == k, F.col(value))).alias(n) for k, n in enumerate(names)])


def split_channels(cells: DataFrame, names: Sequence[str], channel: str = "c", value: str = "v") -> DataFrame:
    """A row for each voxel and channel that has a value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(n).alias("v")) for k, n in enumerate(names)])).alias("__x")
    rest = [c for c in cells.columns if c not in names]
    return cells.select(*rest, each).filter("__x.v is not null").select(*rest, F.col("__x.c").alias(channel), F.col("__x.v").alias(value))


def npy_header(data: bytes) -> tuple[tuple[int, ...], str]:
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return shape, kind.str


def parse_raw(data: bytes, name: str) -> np.ndarray:
    """Shape and type from the name: ..._256x256x128_uint16.raw (x, y, z)."""
    found = re.search(r"(\d+)x(\d+)x(\d+)_(u?int(?:8|16|32)|float32|float64)", name)
    if not found:
        raise ValueError("the name does not tell shape and type")
    x, y, z = map(int, found.groups()[:3])
    return np.frombuffer(data, np.dtype(found[4]).newbyteorder("<")).reshape(z, y, x)


def _packed_bits(data: bytes) -> bytes:
    """PackBits: a count below 128 and so many bytes and one, or a count above and one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


_UNPACK = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packed_bits}


def tiff_pages(data: bytes, only: int | None = None) -> Iterator[np.ndarray]:
    """Pages of a grey TIFF, uncompressed, deflated or packed (codes 1, 8, 32946, 32773), with or without differences along lines (predictor 2).

    only: that page alone; the others are passed over without being read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at, number = struct.unpack(order + "I", data[4:8])[0], -1
    while at:
        number += 1
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
            code, width = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
            if code:
                where = at + 10 + 12 * k if width * count <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                tags[tag] = struct.unpack(order + code * count, data[where : where + width * count])
        following = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        if only is not None and number != only:
            at = following
            continue
        unpack = _UNPACK.get(tags.get(259, (1,))[0])
        if unpack is None or 273 not in tags:
            raise ValueError("this kind of TIFF page is not supported")
        bits, kind = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
        strips = b"".join(unpack(data[o : o + c]) for o, c in zip(tags[273], tags[279], strict=True))
        page = np.frombuffer(strips, dtype).reshape(tags[257][0], tags[256][0])
        yield np.cumsum(page, axis=1, dtype=dtype) if tags.get(317, (1,))[0] == 2 else page
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def write_tiff(volume: np.ndarray) -> bytes:
    """A classic little-endian TIFF, one strip a page."""
    body, pages = bytearray(b"II*\0\0\0\0\0"), []
    for page in volume:
        data = np.ascontiguousarray(page).astype(page.dtype.newbyteorder("<")).tobytes()
        pages.append((len(body), len(data), page))
        body += data + b"\0" * (len(data) % 2)
    link = 4
    for offset, size, page in pages:
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, offset), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, size), (339, 3, kind)]
        body[link : link + 4] = struct.pack("<I", len(body))
        body += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def parse_volume(data: bytes, path: str) -> np.ndarray:
    low = path.lower()
    if low.endswith(".npy"):
        out = parse_npy(data)
    elif low.endswith((".tif", ".tiff")):
        out = np.stack(list(tiff_pages(data)))
    else:
        out = parse_raw(data, path)
    return out if out.ndim == 3 else out.reshape((1,) * (3 - out.ndim) + out.shape)


def chunked(volume: np.ndarray, vol: str, size: int, halo: int = 0) -> Iterator[tuple]:
    nz, ny, nx = volume.shape
    for z in range(0, nz, size):
        for y in range(0, ny, size):
            for x in range(0, nx, size):
                lo = [max(0, v - halo) for v in (z, y, x)]
                part = volume[lo[0] : z + size + halo, lo[1] : y + size + halo, lo[2] : x + size + halo]
                yield (vol, *lo, *part.shape, part.dtype.newbyteorder("<").str, np.ascontiguousarray(part).astype(part.dtype.newbyteorder("<")).tobytes())


def read_chunks(spark: SparkSession, path: str, size: int = 64, halo: int = 0) -> DataFrame:
    """All volumes at a path as chunk rows. A file is one task, as its formats have no index to split by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNK.split(", ")]
        for rows in batches:
            for where, data in zip(rows["path"], rows["content"], strict=True):
                volume = parse_volume(data, where)
                for row in chunked(volume, where.rsplit("/", 1)[-1], size, halo):
                    yield pd.DataFrame([row], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CHUNK)


def array_of(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["nz"], row["ny"], row["nx"])


def voxels(chunks: DataFrame, least: float | None = None) -> DataFrame:
    """(vol, z, y, x, v) of chunks without halo; only v >= least, if given: the sparse form of a mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                a = array_of(row)
                z, y, x = np.nonzero(np.ones(a.shape, bool) if least is None else a >= least)
                yield pd.DataFrame({"vol": row["vol"], "z": z.astype("int32") + row["z0"], "y": y.astype("int32") + row["y0"], "x": x.astype("int32") + row["x0"], "v": a[z, y, x].astype("float64")})

    return chunks.mapInPandas(run, "vol string, z int, y int, x int, v double")


def histogram(chunks: DataFrame) -> DataFrame:
    """(vol, value, n): each task counts its chunks' values first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                value, n = np.unique(array_of(row), return_counts=True)
                yield pd.DataFrame({"vol": row["vol"], "value": value.astype("float64"), "n": n.astype("int64")})

    return chunks.mapInPandas(run, "vol string, value double, n long").groupBy("vol", "value").agg(F.sum("n").alias("n"))
