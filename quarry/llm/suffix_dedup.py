"""Removal of repeated byte strings by a sparse suffix array, built by deep-shallow sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or same document, earlier
start). Sorting every suffix of the corpus is not needed: each string of LENGTH bytes names one of its ANCHOR-byte grams (the
one with the least hash, the leftmost of equals), so equal strings name equal anchors at equal offsets.

1. Anchors. Documents are cut into anchors with the starts that name them; a shuffle of packed anchor hashes drops those that
   occur once. An anchor that a block of documents holds several times is known to repeat, so a very common one is sent once.
2. Contexts. An occurrence's context is all bytes of the strings that name it. Of equal contexts the first occurrence is
   kept; all strings of the others are repeats. (Contexts are compared by hashes modulo a prime beside the equal 64-bit anchor hash.)
3. Suffixes. Where an anchor has several different contexts, their suffixes from the anchor on, and their prefixes read
   backwards, are sorted: multikey quicksort (eight bytes a character) down to a shallow depth, then blind tries for groups
   with longer common prefixes. With both orders and their common prefix lengths, the strings at one offset fall into classes
   of equal bytes, and all but a class's first are repeats. No pairs are made.
4. Anchors with more than HOT contexts are dealt further, by 128-bit hashes: first of runs of STEP neighbouring strings, then,
   of each different run, of every string in it. This deeper radix step spreads one anchor's occurrences over all tasks, and
   what the contexts share is settled a run at a time.
5. Spans meet their documents again, where they are joined and cut out.

Defined cases: null text is empty; a null doc_id is never compared and loses nothing; rows that repeat a doc_id with the same
text are one document read twice: both come back with the same result; rows that repeat a doc_id with other texts are documents of their
own, in the order of their texts' hashes; other columns are ignored; texts under LENGTH bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import buckets_for, chunks, id_and_text, materialize, mix, of_segments, prime_sums, running_hash, segment_hashes, shuffle_partitions, table, text_buffer

LENGTH, ANCHOR = 100, 24
#: Different contexts of one anchor that are sorted in one task.
HOT = 8192
STEP = 8
#: Bytes that the quicksort compares beyond what a group shares; longer common prefixes go to blind tries.
SHALLOW = 16
#: Text of one numpy pass, and of one block of packed anchors.
PASS_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Contexts that are sorted together.
UNIT = 20_000


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor place, first start, last start, anchor hash, context hash) of all anchors; places are in raw."""
    n, w = len(raw), length - gram + 1
    sizes = np.diff(at)
    if not (sizes >= length).any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    total, down = running_hash(raw)
    hashes = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    # least[s] is of the grams in [s, s + w): only starts whose string lies in one text count
    long = np.flatnonzero(sizes >= length)
    count = sizes[long] - length + 1
    text = np.repeat(long, count)
    start = np.repeat(at[long] - (np.cumsum(count) - count), count) + np.arange(len(text))
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    low, high = start[edge], start[np.append(edge[1:], len(start)) - 1]
    place, text = place[edge], text[edge]
    context = mix(of_segments(prime_sums(raw), low, high + length) + (high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - low).astype(np.uint64))
    return text, place, low, high, hashes[place], context


def _planes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


_PARTS = (("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("pos", "<i8"), ("low", "<u1"), ("high", "<u1"), ("many", "<u1"))


def _pack(found: dict[str, np.ndarray], pick: np.ndarray) -> bytes:
    body = b"".join(_planes(np.diff(found[k][pick], prepend=0).astype(kind) if k in ("doc", "hash") else found[k][pick].astype(kind)) for k, kind in _PARTS)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    body, out, done = zstandard.ZstdDecompressor().decompress(data), {}, 0
    n = len(body) // sum(np.dtype(kind).itemsize for _, kind in _PARTS)
    for k, kind in _PARTS:
        size = n * np.dtype(kind).itemsize
        out[k] = _values(body[done : done + size], kind)
        done += size
    out["doc"], out["hash"] = np.cumsum(out["doc"]), np.cumsum(out["hash"])
    return out


def _deal(batches: Iterator[pa.RecordBatch], length: int, gram: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed anchors by bucket; further occurrences of anchors that the block holds several times go to any bucket."""
    part = TaskContext.get().partitionId()
    held, size, block = [], 0, 0

    def emit() -> pa.RecordBatch:
        found = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        distinct, first, inverse, counts = np.unique(found["anchor"], return_index=True, return_inverse=True, return_counts=True)
        found["many"] = (counts > 1)[inverse].astype(np.uint8)
        sent = np.sort(first)
        bucket = (found["anchor"][sent] % np.uint64(n_buckets)).astype(np.int64)
        order = sent[np.argsort(bucket, kind="stable")]
        there, edges = np.unique(np.sort(bucket), return_index=True)
        rows = [(b, _pack(found, order[lo:hi])) for b, lo, hi in zip(there.tolist(), edges, [*edges[1:], len(order)], strict=True)]
        rest = np.ones(len(inverse), bool)
        rest[sent] = False
        rest = np.flatnonzero(rest)
        for k in range(0, len(rest), 5000):
            rows.append(((part * 31 + block * 7 + k // 5000) % n_buckets, _pack(found, rest[k : k + 5000])))
        b, bodies = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    for chunk in chunks(batches, most=PASS_BYTES):
        raw, at = text_buffer(chunk["text"])
        ids, text_hash = chunk["doc_id"].to_numpy(), chunk["text_hash"].to_numpy()
        text, place, low, high, anchor, context = anchors(raw, at, length, gram)
        if len(text):
            held.append({"anchor": anchor, "context": context, "doc": ids[text], "hash": text_hash[text], "pos": place - at[text], "low": place - low, "high": high - low})
        size += len(raw)
        if size >= BLOCK_BYTES and held:
            yield emit()
            held, size, block = [], 0, block + 1
    if held:
        yield emit()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of anchors that occur more than once; rows come by bucket."""

    def emit(held: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack(x) for x in held]
        found = {k: np.concatenate([p[k] for p in parts]) for k, _ in _PARTS}
        _, inverse, counts = np.unique(found["anchor"], return_inverse=True, return_counts=True)
        pick = (counts[inverse] > 1) | (found["many"] > 0)
        kinds = {"anchor": np.int64, "context": np.int64, "doc": np.int64, "hash": np.int64, "pos": np.int64, "low": np.int32, "high": np.int32}
        return pa.RecordBatch.from_arrays([pa.array(found[k][pick].view(np.int64) if found[k].dtype == np.uint64 else found[k][pick].astype(t)) for k, t in kinds.items()], list(kinds))

    bucket, held = None, []
    for batch in batches:
        for b, body in zip(batch["bucket"].to_pylist(), batch["body"].to_pylist(), strict=True):
            if held and b != bucket:
                yield emit(held)
                held = []
            bucket = b
            held.append(body)
    if held:
        yield emit(held)


# --- deep-shallow sorting -------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """The order of strings that share `depth` bytes, and each one's common prefix with the one before (the first: `depth`).

    Inner nodes hold only the place where strings part; a search goes down by single bytes, compares with the one leaf it
    ends at, and adds the branch where they part. A string that ends comes first."""
    root: int | tuple = 0
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while type(node) is tuple:
            at, children = node
            byte = s[at] if at < len(s) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        leaf = node[0] if type(node) is list else node
        lcp = _common(s, strings[leaf])
        parent, byte_in, node = None, 0, root
        while type(node) is tuple and node[0] < lcp:
            byte_in = s[node[0]]
            parent, node = node, node[1][byte_in]
        byte = s[lcp] if lcp < len(s) else -1
        if type(node) is tuple and node[0] == lcp:
            if byte in node[1]:  # only for strings that are equal as far as they go
                old = node[1][byte]
                node[1][byte] = [*(old if type(old) is list else [old]), k]
            else:
                node[1][byte] = k
            continue
        if lcp == len(s) == len(strings[leaf]):
            new: list | tuple = [*(node if type(node) is list else [node]), k]
        else:
            other = strings[leaf]
            new = (lcp, {other[lcp] if lcp < len(other) else -1: node, byte: k})
        if parent is None:
            root = new
        else:
            parent[1][byte_in] = new
    order, common, stack = [], [], [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            keys = sorted(node[1])
            for i in range(len(keys) - 1, -1, -1):
                stack.append((node[1][keys[i]], node[0] if i else shared))
        elif type(node) is list:
            for i, leaf in enumerate(node):
                order.append(leaf)
                common.append(len(strings[leaf]) if i else shared)
        else:
            order.append(node)
            common.append(shared)
    return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray, known: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups (by group number), and each one's common prefix with the one before it in that order.

    Strings of one group share `known` bytes (or are equal and shorter). -1 stands for the start of a group."""
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    width = known + shallow
    grid = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    # a shorter string is told from one with zeros by its length
    keys = [np.minimum(size, width)]
    words = [np.ascontiguousarray(grid[:, d : d + 8]) for d in range(known, width, 8)]
    keys += [np.pad(x, ((0, 0), (0, 8 - x.shape[1]))).view(">u8").ravel().astype(np.uint64) for x in words[::-1]]
    order = np.lexsort([*keys, group])
    common = np.full(n, -1, np.int64)
    a, b = order[:-1], order[1:]
    same_group = group[a] == group[b]
    if n > 1:
        equal = grid[a] == grid[b]
        upto = np.where(equal.all(1), width, equal.argmin(1))
        common[1:] = np.where(same_group, np.minimum(upto, np.minimum(size[a], size[b])), -1)
    # groups that the shallow sort leaves together
    together = np.concatenate(([False], same_group & (common[1:] >= width), [False]))
    edges = np.flatnonzero(np.diff(together.astype(np.int8)))
    for lo, hi in zip(edges[::2], edges[1::2] + 1, strict=True):
        own = order[lo:hi]
        deeper, shared = blind_trie([strings[i] for i in own], width)
        order[lo:hi] = own[deeper]
        common[lo + 1 : hi] = shared[1:]
    return order, common


def repeats(anchor: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, context: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each context and offset of the anchor in a string (0 .. length - gram): whether that string is not the first of its kind."""
    n, w = len(anchor), length - gram + 1
    group = np.unique(anchor, return_inverse=True)[1]
    right_order, right_common = deep_shallow([c[a:] for c, a in zip(context, low.tolist(), strict=True)], group, 0)
    left_order, left_common = deep_shallow([c[:a][::-1] for c, a in zip(context, low.tolist(), strict=True)], group, 0)
    first = np.lexsort((pos, text_hash, doc))
    out = np.zeros((n, w), bool)
    least = low - high  # the offset of the last start
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(w):
        valid = first[(least[first] <= d) & (d <= low[first])]
        if len(valid) < 2:
            continue
        right[right_order] = np.cumsum(right_common < length - d)
        left[left_order] = np.cumsum(left_common < d)
        key = right[valid] * (n + 1) + left[valid]
        _, one = np.unique(key, return_index=True)
        again = np.ones(len(valid), bool)
        again[one] = False
        # the same place read twice is not earlier than itself
        if again.any():
            _, of = np.unique(key, return_inverse=True)
            head = valid[one][of]
            again &= (doc[head] != doc[valid]) | (text_hash[head] != text_hash[valid]) | (pos[head] != pos[valid])
        out[valid[again], d] = True
    return out


def _spans(doc: np.ndarray, text_hash: np.ndarray, pos: np.ndarray, marked: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of marked offsets as byte spans of documents."""
    edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(text_hash[row]), pa.array(pos[row] - end + 1), pa.array(pos[row] - begin + length)], ["doc", "hash", "start", "stop"])


def _sorted_spans(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeats among contexts that come by anchor; whole anchors are sorted, about UNIT contexts at a time."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        anchor, doc, text_hash, pos, low, high = (rows[c].to_numpy() for c in ("anchor", "doc", "hash", "pos", "low", "high"))
        marked = repeats(anchor, doc, text_hash, pos, low.astype(np.int64), high.astype(np.int64), rows["bytes"].to_pylist(), length, gram)
        return _spans(doc, text_hash, pos, marked, length)

    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if len(held) >= UNIT:
            anchor = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and len(held):
        yield emit(held)


# --- the whole -------------------------------------------------------------------------------------------------------------


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From documents with their wanted occurrences: contexts to be sorted, and strings of hot anchors as hashes."""
    names = ["anchor", "doc", "hash", "pos", "low", "high", "bytes", "one", "two", "ones", "twos"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for chunk in chunks(batches, most=PASS_BYTES):
        raw, at = text_buffer(chunk["text"])
        data = raw.tobytes()
        cold: list[tuple] = []
        hot_start, hot_row, hot_offset = [], [], []
        for k, (doc, text_hash, wanted) in enumerate(zip(*(chunk[c].to_pylist() for c in ("doc_id", "text_hash", "wanted")), strict=True)):
            base = int(at[k])
            for o in wanted:
                begin = base + o["pos"] - o["low"]
                if o["hot"]:
                    hot_start.append(np.arange(begin, begin + o["high"] + 1))
                    hot_row.append(np.full(o["high"] + 1, k))
                    hot_offset.append(np.arange(o["low"], o["low"] - o["high"] - 1, -1))
                else:
                    cold.append((o["anchor"], doc, text_hash, o["pos"], o["low"], o["high"], data[begin : begin + o["high"] + length], None, None, None, None))
        for lo in range(0, len(cold), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cold[lo : lo + 20_000], strict=True), kinds, strict=True)], names)
        if hot_start:
            start, row, offset = map(np.concatenate, (hot_start, hot_row, hot_offset))
            other = raw ^ np.uint8(0x5A)
            # runs of strings whose offsets from their anchor share a step
            run = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(offset // STEP, prepend=-1) != 0) | (np.diff(offset, prepend=-9) != -1))
            size = np.diff(np.append(run, len(start)))
            first, last = start[run], start[run] + size - 1
            shape = (offset[run] * 1000 + size).astype(np.uint64)
            keys = [mix(segment_hashes(x, first, last + length) + shape).view(np.int64) for x in (raw, other)]
            edges = pa.array(np.append(run, len(start)), pa.int32())
            each = [pa.ListArray.from_arrays(edges, pa.array(segment_hashes(x, start, start + length).view(np.int64))) for x in (raw, other)]
            n = len(run)
            doc, text_hash, pos = pa.array(chunk["doc_id"].to_numpy()[row[run]]), pa.array(chunk["text_hash"].to_numpy()[row[run]]), pa.array(first - at[row[run]])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), doc, text_hash, pos, pa.nulls(n, pa.int32()), pa.array(size, pa.int32()), pa.nulls(n, pa.binary()), *map(pa.array, keys), *each], names)


def _not_first(strings: DataFrame) -> DataFrame:
    """Spans (doc, hash, start, stop) of all but the first of equal strings (one, two, doc, hash, pos, stop)."""
    heads = strings.groupBy("one", "two").agg(F.min(F.struct("doc", "hash", "pos")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two", "head")
    return strings.join(heads, ["one", "two"]).filter("doc <> head.doc or hash <> head.hash or pos <> head.pos").select("doc", "hash", F.col("pos").alias("start"), "stop")


def _named(docs: DataFrame) -> DataFrame:
    """Texts of documents with an id, with their hashes: the same plan wherever texts are joined, so that they are shuffled once for all joins."""
    return id_and_text(docs).filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = ANCHOR) -> DataFrame:
    """(doc, hash, start, stop, route): byte spans that strings of `length` bytes cover which also start earlier; they may overlap.

    hash: of the document's text. route: what showed it (`equal contexts`, `sorted suffixes` or `common anchors`)."""
    spark = docs.sparkSession
    n, n_buckets = shuffle_partitions(spark), buckets_for(docs)
    texts = _named(docs)
    packed = texts.mapInArrow(lambda b: _deal(b, length, gram, n_buckets), "bucket int, body binary")
    occurrences = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "anchor long, context long, doc long, hash long, pos long, low int, high int")
    occurrences = materialize(occurrences, "occurrences", compression="zstd")
    firsts = occurrences.groupBy("anchor", "context").agg(F.min(F.struct("doc", "hash", "pos", "low", "high")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.select("anchor", "context", F.col("first.*"), "n"), "firsts", compression="zstd")
    # equal contexts: all but the first repeat it
    heads = firsts.filter("n > 1").select("anchor", "context", F.col("doc").alias("doc1"), F.col("hash").alias("hash1"), F.col("pos").alias("pos1"))
    copies = occurrences.join(heads, ["anchor", "context"]).filter("doc <> doc1 or hash <> hash1 or pos <> pos1").select("doc", "hash", (F.col("pos") - F.col("low")).alias("start"), (F.col("pos") - F.col("low") + F.col("high") + length).alias("stop"))
    # different contexts of one anchor
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    sorted_here = firsts.join(several.filter(F.col("contexts") <= HOT), "anchor")
    found = _wanted(texts, sorted_here, length)
    cold = found.select("anchor", "doc", "hash", "pos", "low", "high", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor")
    parted = cold.mapInArrow(lambda b: _sorted_spans(b, length, gram), "doc long, hash long, start long, stop long")
    spans = copies.withColumn("route", F.lit("equal contexts")).unionByName(parted.withColumn("route", F.lit("sorted suffixes")))
    too_many = several.filter(F.col("contexts") > HOT)
    if too_many.limit(1).count():
        hot = _wanted(texts, firsts.join(too_many, "anchor"), length)
        runs = hot.select("one", "two", "doc", "hash", "pos", (F.col("pos") + F.col("high") - 1 + length).alias("stop"))
        kept = hot.groupBy("one", "two").agg(F.min(F.struct("doc", "hash", "pos", "ones", "twos")).alias("kept")).select("kept.*")
        strings = kept.select("doc", "hash", "pos", F.posexplode(F.arrays_zip("ones", "twos")).alias("k", "both")).select("doc", "hash", (F.col("pos") + F.col("k")).alias("pos"), F.col("both.ones").alias("one"), F.col("both.twos").alias("two"))
        common = _not_first(runs).unionByName(_not_first(strings.withColumn("stop", F.col("pos") + length)))
        spans = spans.unionByName(common.withColumn("route", F.lit("common anchors")))
    return spans


def _wanted(texts: DataFrame, occurrences: DataFrame, length: int) -> DataFrame:
    """Contexts (or string hashes, for hot anchors) of the occurrences, taken from their documents' texts."""
    lists = occurrences.groupBy(F.col("doc").alias("doc_id"), F.col("hash").alias("text_hash")).agg(F.collect_list(F.struct("anchor", "pos", "low", "high", (F.col("contexts") > HOT).alias("hot"))).alias("wanted"))
    fields = "anchor long, doc long, hash long, pos long, low int, high int, bytes binary, one long, two long, ones array<long>, twos array<long>"
    return texts.join(lists, ["doc_id", "text_hash"]).mapInArrow(lambda b: _contexts(b, length), fields)


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _fields(with_text).split(", ")]
    for chunk in chunks(batches):
        raw, at = text_buffer(chunk["text"])
        out = []
        for k, (doc, spans) in enumerate(zip(chunk["doc_id"].to_pylist(), chunk["spans"].to_pylist(), strict=True)):
            text = raw[at[k] : at[k + 1]]
            if spans:
                edge = np.zeros(len(text) + 1, np.int64)
                both = np.array([(s["start"], s["stop"]) for s in spans])
                np.add.at(edge, both[:, 0], 1)
                np.add.at(edge, both[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = text[~gone].tobytes()
            else:
                n_spans, kept = 0, text.tobytes()
            row = (doc, len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names)


def _fields(with_text: bool) -> str:
    return "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Each document without its repeated bytes (column kept, on request), with counts and a digest of what is left."""
    found = repeated_spans(docs, length, gram).select(F.col("doc").alias("doc_id"), F.col("hash").alias("text_hash"), "start", "stop").distinct()
    spans = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = _named(docs).join(spans, ["doc_id", "text_hash"], "left")
    nameless = id_and_text(docs).filter("doc_id is null").withColumn("text_hash", F.lit(0).cast("long")).withColumn("spans", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"))
    cut = lambda df: df.mapInArrow(lambda b: _cut(b, with_text), _fields(with_text))
    return cut(joined).unionByName(cut(nameless))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
p AS (SELECT doc_id, island, min(s) AS b, max(s) + 100 AS e FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, e, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS nb FROM p),
k AS (SELECT doc_id, 0 AS e, min(b) AS nb FROM p GROUP BY 1 UNION ALL SELECT doc_id, e, nb FROM g),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * e + 1, 2 * (coalesce(nb, length(h) // 2) - e)), '' ORDER BY e) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM p GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
