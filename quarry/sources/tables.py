"""Tabular sources and sinks with contracts."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strict_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """All columns as text. The header must be exactly `fields`, and a row of another length is an error."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    header = spark.read.option("header", False).option("multiLine", True).csv(path).limit(1).collect()
    seen = [str(x or "").lstrip("﻿") for x in header[0]] if header else []
    if seen != list(fields):
        raise ValueError(f"header is {seen}, not {list(fields)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_projected_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).csv(path)
    return df.select(*columns) if columns else df


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row from one JSON object; a pointer to an absent large file is refused."""
    raw = spark.read.text(path, wholetext=True)
    if raw.filter(F.col("value").startswith("version https://git-lfs")).limit(1).count():
        raise ValueError("the file is only a pointer to a large object")
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_safe(value: Any) -> Any:
    """Plain JSON values; numbers that are not finite are refused."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if hasattr(value, "item") and not isinstance(value, str | bytes):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a finite number")
    return value


def canonical_json(value: Any) -> bytes:
    return (json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()


def write_once(path: str, data: bytes) -> bool:
    """Writes a file whole or not at all. The same bytes again are fine (False), others an error."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == data:
                return False
        raise FileExistsError(f"{path} holds something else")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return True


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """CSV with a header: of exactly `fields`, in their order, or as the columns come. A missing or further column, and text that CSV
    could not give back (null beside empty text), are errors; an existing table is not replaced."""
    names = list(fields) if fields is not None else df.columns
    if set(names) != set(df.columns) or len(set(names)) != len(names):
        raise ValueError(f"columns are {df.columns}, not {names}")
    df.select(*names).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("nullValue", "\u0000").mode("error").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted, nulls written out; numbers that are not finite are an error."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    wrong = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    for c in numbers:
        df = df.withColumn(c, F.when(wrong(F.col(c)), F.raise_error(F.lit(f"{c}: not a finite number")).cast("double")).otherwise(F.col(c)))
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).mode("error").json(path)


def append_rows(df: DataFrame, path: str, key: str) -> None:
    """Appends rows to a Parquet table; a key that is there already, or twice among the new rows, is an error."""
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key}: repeated among the new rows")
    there = df.sparkSession.read.parquet(path)
    if not df.join(there.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"{key}: already there")
    df.select(there.columns).write.mode("append").parquet(path)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of all files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    return files.select(F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def within(path: str, roots: Iterable[str], suffixes: Sequence[str]) -> str:
    """The real path, if it lies in one of the folders and its suffix is allowed."""
    real = os.path.realpath(path)
    if not any(real == r or real.startswith(r + os.sep) for r in map(os.path.realpath, roots)):
        raise PermissionError("path is outside the allowed folders")
    if os.path.splitext(real)[1].lower() not in suffixes:
        raise ValueError("file type is not allowed")
    return real


def digest_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
