"""Helpers shared by the text operators: shared storage, whole-text byte buffers, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import materialize, release, shared_dir

__all__ = ["materialize", "release", "shared_dir"]

#: glibc's way to return free memory; null where the C library has none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

#: Bytes of text that one numpy pass works on; it bounds a Python worker's memory.
CHUNK_BYTES = 4 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between the JVM and a worker. The default of 10,000 rows or 64 MB is held several times over on both sides.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg")) * factor
    if size < 0 or size > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table holds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of a table's text for each hash bucket at most: a worker holds what it keeps of one bucket.
BUCKET_BYTES = 64 << 20


def buckets_for(docs: DataFrame) -> int:
    """How many hash buckets a table's pieces of text are dealt to: four a shuffle partition, more where the table's estimated size asks for it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # what Spark can't tell it takes for as much as a number holds
    return max(4 * shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES if known else 0)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, with n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches cut or joined into tables of about `most` bytes of text; a longer single text stays whole."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        _, at = text_buffer(whole[text])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + most - size, "right")) - 1
            if stop <= start:
                if held:
                    yield pa.concat_tables(held)
                    held, size = [], 0
                    continue
                stop = start + 1
            held.append(whole.slice(start, stop - start))
            size += int(at[stop] - at[start])
            start = stop
            if size >= most:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)
    del held
    give_back()


def give_back() -> None:
    """Memory that this worker no longer uses goes back to the machine: workers live on between tasks and operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, one for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0x9E3779B97F4A7C15
#: A prime, and two bases, for hashes that no choice of bytes can make collide by their powers alone.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1103515245, 69069 * 7919 + 2)
_BYTES = byte_table(0x51)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers


def running_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers (n + 1 of them), and the inverse powers that shift a difference to its start."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return total, down


_prime_powers: list[np.ndarray] = []


def _prime_power(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo the prime; kept for the next call."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        most, made = max(n, 1 << 20), []
        for base in (b for own in _BASES for b in (own, pow(own, -1, int(_PRIME)))):
            powers = np.ones(1, np.uint64)
            while len(powers) < most:
                powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), int(_PRIME))) % _PRIME])
            made.append(powers[:most].astype(np.uint32))
        _prime_powers[:] = made
    return _prime_powers


def prime_sums(raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases the running sums (n + 1) of bytes times powers modulo the prime, and the inverse powers."""
    powers, out = _prime_power(len(raw) + 1), []
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    for k in range(2):
        total, step = np.zeros(len(raw) + 1, np.uint64), 1 << 22
        for lo in range(0, len(raw), step):  # a term has 40 bits at most, so a step's sum fits
            part = total[lo + 1 : lo + 1 + step]
            np.cumsum(values[lo : lo + step] * powers[2 * k][lo : lo + len(part)], out=part)
            if lo:
                part += total[lo] % _PRIME
        out.append((total, powers[2 * k + 1]))
    return out


def of_segments(sums: list[tuple[np.ndarray, np.ndarray]], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[begin:end] from its prime_sums."""
    one, two = ((total[end] - total[begin]) % _PRIME * down[begin] % _PRIME for total, down in sums)
    return mix((one << np.uint64(31) | two) + mix((end - begin).astype(np.uint64)))


def segment_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[begin:end]: polynomials of two bases modulo a prime, by differences of running sums."""
    return of_segments(prime_sums(raw), begin, end)


# --- filters on keys: bitmaps of a bounded size -----------------------------------------------------------------------------------

#: Bits of a filter at most (16 MB), and bits of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 27, 1 << 15


def key_filter(keys: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """A filter on stored keys: rows (bucket, bits), and how many bits it has: 16 for each key, FILTER_BITS at most.

    It never misses a key; with more keys than it has bits it lets most others through too, but stays right."""
    n_bits = ROW_BITS
    while n_bits < min(16 * keys.count(), FILTER_BITS):
        n_bits *= 2
    at = F.xxhash64(*columns).bitwiseAND(n_bits - 1)
    rows = keys.select(F.shiftright(at, 15).cast("int").alias("bucket"), at.bitwiseAND(ROW_BITS - 1).alias("pos"))
    return rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(pos)").alias("bits")), n_bits


def maybe_in(rows: DataFrame, found: tuple[DataFrame, int], *columns: Column) -> tuple[DataFrame, DataFrame]:
    """The rows, each as a struct `row`, parted by a filter: those whose key may be in it, and those whose key is certainly not.

    Its size is bounded by FILTER_BITS, so it is broadcast, and rows of the second kind need no shuffle."""
    bitmap, n_bits = found
    at = F.xxhash64(*columns).bitwiseAND(n_bits - 1)
    asked = rows.select(F.struct("*").alias("row"), F.shiftright(at, 15).cast("int").alias("bucket"), at.bitwiseAND(ROW_BITS - 1).cast("int").alias("pos"))
    joined = asked.join(F.broadcast(bitmap), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("pos") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("getbit(byte, cast(pos % 8 as int))") == 1, F.lit(False))
    judged = joined.withColumn("byte", byte).withColumn("hit", hit)
    return judged.filter("hit").select("row"), judged.filter("not hit").select("row")


def package_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, file: str):
    """A vocabulary file's bytes as a broadcast: its size is fixed and small, and executors need no such file."""
    with open(file, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{os.path.basename(file)} is too large to broadcast")
    return spark.sparkContext.broadcast(data)
