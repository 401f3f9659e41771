"""Triangles and points from STL and PLY files, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TRIANGLE = "mesh string, triangle long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")
_RECORD = np.dtype([("normal", "<f4", 3), ("vertices", "<f4", (3, 3)), ("attribute", "<u2")])


def parse_stl(data: bytes) -> np.ndarray:
    """Vertices (n, 3, 3). A binary file is known by its size, whatever its header says."""
    if len(data) >= 84 and len(data) == 84 + 50 * int.from_bytes(data[80:84], "little"):
        return np.frombuffer(data, _RECORD, offset=84)["vertices"].astype(float)
    numbers = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
    if len(numbers) % 3 or not data.lstrip().startswith(b"solid"):
        raise ValueError("neither a binary nor an ASCII STL")
    return np.array(numbers, float).reshape(-1, 3, 3)


def write_stl(vertices: np.ndarray) -> bytes:
    records = np.zeros(len(vertices), _RECORD)
    records["vertices"] = vertices
    return b"\0" * 80 + len(vertices).to_bytes(4, "little") + records.tobytes()


def parse_ply_points(data: bytes) -> pd.DataFrame:
    """The vertex element of an ASCII or binary little-endian PLY, a column for each scalar property."""
    end = data.index(b"end_header\n") + 11
    lines = data[:end].decode("ascii").split("\n")
    if lines[0] != "ply":
        raise ValueError("not a PLY file")
    kind = next(x.split()[1] for x in lines if x.startswith("format"))
    types = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
    n, fields, on = 0, [], False
    for line in lines:
        words = line.split()
        if words[:1] == ["element"]:
            on = words[1] == "vertex"
            n = int(words[2]) if on else n
        elif words[:1] == ["property"] and on:
            fields.append((words[2], types[words[1]]))
    if kind == "ascii":
        rows = [x.split()[: len(fields)] for x in data[end:].decode("ascii").split("\n")[:n]]
        return pd.DataFrame({name: np.array([r[k] for r in rows], float).astype(t) for k, (name, t) in enumerate(fields)})
    if kind != "binary_little_endian":
        raise ValueError("big-endian PLY is not supported")
    return pd.DataFrame(np.frombuffer(data, np.dtype(fields), n, end))


def write_ply(vertices: np.ndarray, faces: np.ndarray | None = None) -> bytes:
    """A binary little-endian PLY of points (n, 3) and, if given, triangles as places of points (m, 3)."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\n"
    body = np.ascontiguousarray(vertices, "<f4").tobytes()
    if faces is not None:
        head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\n"
        rows = np.zeros(len(faces), np.dtype([("n", "u1"), ("at", "<i4", 3)]))
        rows["n"], rows["at"] = 3, faces
        body += rows.tobytes()
    return (head + "end_header\n").encode("ascii") + body


def ply_header(data: bytes) -> dict[str, int]:
    """How many of each element a PLY holds, in the order of the file."""
    end = data.index(b"end_header")
    if not data.startswith(b"ply"):
        raise ValueError("not a PLY file")
    return {w[1]: int(w[2]) for w in (x.split() for x in data[:end].decode("ascii").split("\n")) if w[:1] == ["element"]}


def read_triangles(spark: SparkSession, path: str, batch: int = 50_000) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"{v}{x}" for v in "abc" for x in "xyz"]
        for rows in batches:
            for where, data in zip(rows["path"], rows["content"], strict=True):
                v = parse_stl(data)
                for lo in range(0, len(v), batch):
                    part = pd.DataFrame(v[lo : lo + batch].reshape(-1, 9), columns=names)
                    part.insert(0, "triangle", np.arange(lo, lo + len(part)))
                    part.insert(0, "mesh", where.rsplit("/", 1)[-1])
                    yield part

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRIANGLE)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """mesh, point, x, y, z of PLY files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for where, data in zip(rows["path"], rows["content"], strict=True):
                p = parse_ply_points(data)
                yield pd.DataFrame({"mesh": where.rsplit("/", 1)[-1], "point": np.arange(len(p)), **{c: p[c].astype(float) for c in "xyz"}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "mesh string, point long, x double, y double, z double")
