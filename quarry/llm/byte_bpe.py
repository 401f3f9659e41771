"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut, in blocks, into pre-token groups (white space and the run of text after it; a group boundary is always a
boundary of the split pattern). Of each block only its distinct groups travel, packed by a hash of the group, with the
positions kept as one array of codes for each document. All that share a hash bucket meet in one task, which encodes each
distinct group once; the ids go back to their blocks, where documents are put together by position. Decoding joins ids with the token-byte table, whose size is that of
the vocabulary.

Defined cases: null text is empty: no ids, and the digests of empty strings; a null doc_id is passed on; repeated rows give
repeated rows; other columns are ignored; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import buckets_for, chunks, id_and_text, materialize, package_path, segment_hashes, ship, shuffle_partitions, table, text_buffer

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in one block.
BLOCK_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def group_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of pre-token groups: of texts, and of ASCII white space that follows anything but white space."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    space = _SPACE[raw]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    # a byte of a multi-byte character in front: it may be one of Unicode's spaces, then there is no cut
    wide = np.flatnonzero(cut & np.concatenate(([False], raw[:-1] >= 0x80)))
    if len(wide):
        two, three = raw[np.maximum(wide - 2, 0)], raw[np.maximum(wide - 3, 0)]
        cut[wide[(two == 0xC2) | (three >= 0xE1) & (three <= 0xE3)]] = False
    begins = at[:-1]
    cut[begins[begins < n]] = True
    return np.flatnonzero(cut)


def dictionary(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct groups, and each group's place among them."""
    offsets = np.append(starts, len(raw)).astype(np.int64)
    groups = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    encoded = groups.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed plane by plane: small numbers cost about a byte."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _deal(batches: Iterator[pa.RecordBatch], n_buckets: int, only: str = "") -> Iterator[pa.RecordBatch]:
    """Of each block: its documents as sequences of codes (bucket -1), and its distinct groups, dealt to buckets by their hash.

    only: `documents` or `groups`. A block is named by its scan partition and by its number there with a checksum of its text, so both
    halves of one block can only meet if both have seen the same text."""
    press = zstandard.ZstdCompressor(level=3).compress
    for k, chunk in enumerate(chunks(batches, most=BLOCK_BYTES)):
        raw, at = text_buffer(chunk["text"])
        part = chunk["part"][0].as_py()
        block = k << 32 | zlib.crc32(raw)
        named = lambda n, part=part, block=block: [pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, block, np.int64))]
        starts = group_starts(raw, at)
        words, codes = dictionary(raw, starts)
        if len(codes):  # frequent groups get small codes
            order = np.argsort(-np.bincount(codes), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            codes = rank[codes]
        else:
            rank = np.zeros(0, np.uint32)
        if only != "groups":
            first = np.searchsorted(starts, at)
            bodies = [_pack(codes[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
            n = len(bodies)
            yield pa.RecordBatch.from_arrays([*named(n), pa.array(np.full(n, -1, np.int32)), chunk["doc_id"].combine_chunks(), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(bodies, pa.binary())], _FIELDS)
        if only == "documents":
            continue
        text, ends = text_buffer(words)
        bucket = (segment_hashes(text, ends[:-1], ends[1:]) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((rank, bucket))
        size = np.diff(ends)
        there, edges = np.unique(bucket[order], return_index=True)
        rows = []
        for b, lo, hi in zip(there.tolist(), edges, [*edges[1:], len(order)], strict=True):
            own = order[lo:hi]
            end = np.cumsum(size[own])
            body = text[np.repeat(ends[own] - (end - size[own]), size[own]) + np.arange(end[-1])]
            rows.append((b, _pack(np.diff(rank[own], prepend=np.uint32(0))), _pack(size[own]), press(body.tobytes())))
        if rows:
            b, numbers, sizes, bodies = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*named(len(b)), pa.array(b, pa.int32()), pa.nulls(len(b), pa.int64()), pa.array(numbers, pa.binary()), pa.array(sizes, pa.binary()), pa.array(bodies, pa.binary())], _FIELDS)


_FIELDS = ["part", "block", "bucket", "doc_id", "codes", "sizes", "body"]
_DEALT = "part long, block long, bucket int, doc_id long, codes binary, sizes binary, body binary"

_made: dict = {}


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _encoder(data: bytes, pattern: str):
    """Once for each worker process."""
    key = ("encoder", len(data), pattern)
    if key not in _made:
        import tiktoken

        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _made[key]


def _token_bytes(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """For each id its bytes, and its decimal digits."""
    key = ("bytes", len(data))
    if key not in _made:
        ranks = ranks_of(data)
        found: list[bytes] = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            found[rank] = token
        _made[key] = found, [b"%d" % i for i in range(len(found))]
    return _made[key]


def encode_blocks(docs: DataFrame, file: str, pattern: str, scanned: bool = False) -> DataFrame:
    """Rows of _FIELDS: of each block its documents as codes (bucket -1), and ids (body) with their counts (sizes) for all codes.

    scanned: the documents are a plain table scan, which gives the same partitions each time; it is then cut into blocks twice
    instead of storing the codes once more. A block that changed between the two raises an error."""
    spark = docs.sparkSession
    data, n = ship(spark, file), shuffle_partitions(spark)
    n_buckets = buckets_for(docs)
    # the number of the partition within its scan, which a union does not change
    texts = id_and_text(docs).withColumn("part", F.spark_partition_id().cast("long"))
    if scanned:
        documents = texts.mapInArrow(lambda batches: _deal(batches, n_buckets, "documents"), _DEALT)
        groups = texts.mapInArrow(lambda batches: _deal(batches, n_buckets, "groups"), _DEALT)
    else:
        dealt = materialize(texts.mapInArrow(lambda batches: _deal(batches, n_buckets), _DEALT), "dealt")
        documents, groups = dealt.filter("bucket < 0"), dealt.filter("bucket >= 0")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("part", "block", "bucket", "codes", "sizes", "body")), strict=True):
                if held and held[0][2] != row[2]:
                    yield _encode_bucket(held, _encoder(data.value, pattern).encode_ordinary)
                    held = []
                held.append(row)
        if held:
            yield _encode_bucket(held, _encoder(data.value, pattern).encode_ordinary)

    words = groups.repartition(n, "bucket").sortWithinPartitions("bucket")
    return words.mapInArrow(encode, _DEALT).unionByName(documents)


def _encode_bucket(rows: list[tuple], encode_one) -> pa.RecordBatch:
    """All blocks' rows of one bucket: each of its distinct groups is encoded once."""
    press = zstandard.ZstdDecompressor()
    sizes = [_unpack(r[4]) for r in rows]
    body = b"".join(press.decompress(r[5]) for r in rows)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
    words, place = dictionary(np.frombuffer(body, np.uint8), ends[:-1])
    lists = [encode_one(w.decode("utf-8", "replace")) for w in words.to_pylist()]
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for ids in lists for i in ids), np.uint32, count.sum())
    offsets = np.concatenate(([0], np.cumsum(count)))
    out_sizes, out_ids, done = [], [], 0
    for own in sizes:
        mine = place[done : done + len(own)]
        out_sizes.append(_pack(count[mine]))
        out_ids.append(_pack(gather(flat, offsets, mine)))
        done += len(own)
    n = len(rows)
    part, block, bucket, codes = zip(*(r[:4] for r in rows), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.nulls(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(out_sizes, pa.binary()), pa.array(out_ids, pa.binary())], _FIELDS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """For each run of document rows: ids of the block's groups, their offsets, the rows. Rows come by block, buckets falling to -1."""
    held: list[tuple] = []
    block, ready = None, None
    for batch in batches:
        parts, blocks, buckets = (batch[c].to_numpy() for c in ("part", "block", "bucket"))
        edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(blocks) != 0) | ((buckets[1:] < 0) != (buckets[:-1] < 0))) + 1
        for lo, hi in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if hi <= lo:
                continue
            if (parts[lo], blocks[lo]) != block:
                block, held, ready = (parts[lo], blocks[lo]), [], None
            if buckets[lo] >= 0:
                held += zip(*(batch[c].slice(lo, hi - lo).to_pylist() for c in ("codes", "sizes", "body")), strict=True)
                continue
            if ready is None:
                ready, held = _by_code(held), []
            yield *ready, pa.Table.from_batches([batch.slice(lo, hi - lo)])


def _by_code(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block in order of code, and their offsets."""
    if not held:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    codes = np.concatenate([np.cumsum(_unpack(c), dtype=np.int64) for c, _, _ in held])
    size = np.concatenate([_unpack(s) for _, s, _ in held]).astype(np.int64)
    ids = np.concatenate([_unpack(i) for _, _, i in held])
    came = np.concatenate(([0], np.cumsum(size)))
    order = np.argsort(codes)
    if not np.array_equal(codes[order], np.arange(len(codes))):
        raise ValueError("a block's words are not complete")
    return gather(ids, came, order), np.concatenate(([0], np.cumsum(size[order])))


def gather(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of a sequence of groups."""
    if len(codes) and int(codes.max()) + 1 >= len(offsets):
        raise ValueError("a block's words are not complete")
    size = offsets[codes + 1] - offsets[codes]
    end = np.cumsum(size)
    if not len(end) or not end[-1]:
        return np.zeros(0, ids.dtype)
    return ids[np.repeat(offsets[codes] - (end - size), size) + np.arange(end[-1])]


def tokens(docs: DataFrame, file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and its ids (array of int)."""
    return _assembled(docs, file, pattern, False)


def token_digests(docs: DataFrame, file: str | None = None, pattern: str | None = None, scanned: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    return _assembled(docs, file, pattern, True, scanned)


def _assembled(docs: DataFrame, file: str | None, pattern: str | None, digest: bool, scanned: bool = False) -> DataFrame:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    file = file or package_path(VOCABULARY)
    spark = docs.sparkSession
    data = ship(spark, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, decimal = _token_bytes(data.value)
        for ids, offsets, rows in _blocks(batches):
            counts, seen, back = [], [], []
            for body in rows["body"].to_pylist():
                own = gather(ids, offsets, _unpack(body))
                if not digest:
                    back.append(own.astype(np.int32))
                    continue
                listed = own.tolist()
                counts.append(len(listed))
                seen.append(hashlib.sha256(b",".join([decimal[i] for i in listed])).hexdigest())
                back.append(hashlib.sha256(b"".join([token[i] for i in listed])).hexdigest())
            doc_id = rows["doc_id"].combine_chunks()
            if digest:
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(seen, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(back, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = encode_blocks(docs, file, pattern, scanned).repartition(shuffle_partitions(spark), "part", "block").sortWithinPartitions("part", "block", F.desc("bucket"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>")


def decode(ids: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids (column ids): the token-byte table is joined in each worker. Null ids are none."""
    data = ship(ids.sparkSession, file or package_path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, _ = _token_bytes(data.value)
        for batch in batches:
            bodies = [b"".join([token[i] for i in row or ()]) for row in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bodies, pa.binary())], ["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, bytes binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), scanned=True)
