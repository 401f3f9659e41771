"""Packing of token sequences into windows: a histogram is solved by non-negative least squares, the rest packed greedily.

Each document's ids, with an end id, are cut into whole windows and one shorter tail. The histogram of tail lengths (at most
as many entries as a window has tokens, whatever the input) goes to the driver, which enumerates combinations of up to three
lengths that fill a window exactly, solves their repeat counts by non-negative least squares, rounds them down to what
the histogram holds, and fills on with the residuals' exact combinations. Tails left over are packed greedily, longest first, end to end, and cut where a window ends; the last,
incomplete window becomes sequences whose lengths are powers of two, which need no padding. A tail finds its place from its
rank among the tails of its length, so no stage gathers documents.

Defined cases: null text is empty: the end id alone; a null doc_id is passed on; repeated rows are packed each; other columns
are ignored; no documents give no pieces.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._util import chunks, id_and_text, materialize, package_path, ship, table, text_buffer

VOCABULARY = "word_bpe_49k.json"
WINDOW, END_ID = 2048, 1
#: Combinations that the solver looks at, and its sweeps.
COLUMNS, SWEEPS = 20_000, 12
#: Words whose ids a worker keeps.
KEPT_WORDS = 50_000
#: Bytes of text whose distinct words are looked up together.
BLOCK_BYTES = 2 << 20

_SPACE, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[ord("'")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces of text that the tokenizer treats apart, each piece's place among them, and the first piece of each text.

    Pieces end at ASCII white space (dropped) and between ASCII letters and marks other than the apostrophe."""
    raw = _LOWER[raw]
    space, letter, mark = _SPACE[raw], _LETTER[raw], _MARK[raw]
    start = np.ones(len(raw) + 1, bool)
    start[1:-1] = space[:-1] | letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
    start[at] = True
    solid = ~space
    start = start[:-1] & solid
    first = np.searchsorted(np.flatnonzero(start), at)
    kept = raw[solid]
    offsets = np.append(np.flatnonzero(start[solid]), len(kept)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    found = pieces.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


_made: dict = {}


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write bytes as: printable ones stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(other)}}


_LETTERS = _byte_letters()
#: The last of the Latin letters that come composed, and the one whose lower case is two characters.
_LATIN, _DOTTED = chr(0x24F), chr(0x130)


def _word_ids(word: str, model) -> list[int] | None:
    """Ids of a word of Latin letters, straight from the merges; null for other words, which take the tokenizer's whole way."""
    if not word.isalpha():
        return None
    if word.isascii():
        word = word.lower()
    elif max(word) > _LATIN or _DOTTED in word:
        return None
    else:
        word = word.lower().encode().decode("latin-1").translate(_LETTERS)
    return [t.id for t in model.tokenize(word)]


def _tokenizer(data: bytes):
    """The tokenizer, its merges if words may go to them directly, and the words it has met; once for each worker process."""
    key = len(data)
    if key not in _made:
        # a task has one core; the library's threads would also keep memory of their own each
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(data)
        made.encode_special_tokens = True
        model = made.model
        probes = ["a", "the", "streaming", "\u00e9t\u00e9", "stra\u00dfe", "\u0153uvre", "\u01c6"]
        same = all(_word_ids(w, model) == made.encode(w, add_special_tokens=False).ids for w in probes)
        _made[key] = made, model if same else None, {}
    return _made[key]


def _encode_words(words: list[str], often: list[bool], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids, and offsets. A worker keeps the ids, as bytes, of words that a chunk holds more than once."""
    tokenizer, model, known = _tokenizer(data)
    found = list(map(known.get, words))
    slow = []
    for k, ids in enumerate(found):
        if ids is None:
            made = _word_ids(words[k], model) if model is not None else None
            if made is None:
                slow.append(k)
                continue
            found[k] = ids = array("I", made).tobytes()
            if often[k] and len(known) < KEPT_WORDS:
                known[words[k]] = ids
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    for lo in range(0, len(slow), 1_000):
        part = slow[lo : lo + 1_000]
        for k, made in zip(part, encode([words[k] for k in part], add_special_tokens=False), strict=True):
            found[k] = array("I", made.ids).tobytes()
            if often[k] and len(known) < KEPT_WORDS:
                known[words[k]] = found[k]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))) // 4
    return np.frombuffer(b"".join(found), np.uint32), offsets


def pieces(docs: DataFrame, file: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Whole windows and tails: part and rank (its number among the part's pieces of one length), ids of tails in body."""
    data = ship(docs.sparkSession, file or package_path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        met: dict[int, int] = defaultdict(int)
        for chunk in chunks(batches, most=BLOCK_BYTES):
            raw, at = text_buffer(chunk["text"])
            words, codes, first = words_of(raw, at)
            flat, offsets = _encode_words(words.cast(pa.large_string()).to_pylist(), (np.bincount(codes, minlength=len(words)) > 1).tolist(), data.value)
            size = offsets[1:] - offsets[:-1]
            rows = []
            for doc_id, lo, hi in zip(chunk["doc_id"].to_pylist(), first[:-1], first[1:], strict=True):
                own = codes[lo:hi]
                n = size[own]
                end = np.cumsum(n)
                total = int(end[-1]) if len(end) else 0
                ids = np.empty(total + 1, "<u4")
                if total:
                    ids[:-1] = flat[np.repeat(offsets[own] - (end - n), n) + np.arange(total)]
                ids[-1] = end_id
                for start in range(0, total + 1, window):
                    cut = ids[start : start + window]
                    body = cut.tobytes()
                    rows.append((doc_id, total + 1, start, len(cut), zlib.crc32(body), met[len(cut)], None if len(cut) == window else body))
                    met[len(cut)] += 1
            doc, n_tokens, start, length, crc, rank, body = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), pa.array(doc, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rank, pa.int64()), pa.array(body, pa.binary())],
                ["part", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "rank", "body"],
            )

    return id_and_text(docs).mapInArrow(run, "part long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, rank long, body binary")


def combinations(lengths: list[int], window: int, most: int = COLUMNS) -> list[tuple[int, ...]]:
    """Up to three of the lengths, with repeats, that fill a window; pairs first, triples evenly spread over what there are."""
    there, found = set(lengths), []
    found += [(a, window - a) for a in lengths if 2 * a <= window and window - a in there]
    short = [a for a in lengths if 3 * a <= window]
    room = max(0, most - len(found))
    triples = sum(bisect.bisect_right(lengths, (window - a) // 2) - bisect.bisect_left(lengths, a) for a in short)
    step = max(1, -(-triples // max(1, room)))
    k = 0
    for a in short:
        for b in lengths[bisect.bisect_left(lengths, a) : bisect.bisect_right(lengths, (window - a) // 2)]:
            k += 1
            if k % step == 0 and window - a - b in there:
                found.append((a, b, window - a - b))
    return found


def repeat_counts(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares by coordinate descent: counts x of the columns, so that their lengths add up to the histogram."""
    rest = {k: float(v) for k, v in histogram.items()}
    counted = []
    for column in columns:
        times = {k: column.count(k) for k in set(column)}
        counted.append((list(times.items()), sum(c * c for c in times.values())))
    x = [0.0] * len(columns)
    order = sorted(range(len(columns)), key=lambda p: (-min(histogram[k] / c for k, c in counted[p][0]), len(columns[p])))
    for _ in range(sweeps):
        moved = 0.0
        for p in order:
            items, norm = counted[p]
            step = max(-x[p], sum(c * rest[k] for k, c in items) / norm)
            if step:
                x[p] += step
                moved += abs(step)
                for k, c in items:
                    rest[k] -= c * step
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[dict[int, list[tuple]], list[int]]:
    """Where the pieces of each length go, by rank: (first rank, kind, ...), and where the stream of what is left over is cut.

    kind 0: (lo, 0, first sequence, copies in a sequence, offset of the first copy); kind 1: (lo, 1, position in the stream)."""
    placed: dict[int, list[tuple]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    tails = {k: v for k, v in histogram.items() if 0 < k < window and v}
    sequences = histogram.get(window, 0)
    if sequences:
        placed[window].append((0, 0, 0, 1, 0))
    columns = combinations(sorted(tails), window)
    counts = repeat_counts(columns, tails)
    left = dict(tails)

    def fill(column: tuple[int, ...], most: int) -> int:
        """Place a column up to `most` times, as long as its lengths are there."""
        nonlocal sequences
        times = {k: column.count(k) for k in sorted(set(column))}
        repeats = min(most, *(left[k] // c for k, c in times.items()))
        if repeats <= 0:
            return 0
        offset = 0
        for k, c in times.items():
            placed[k].append((used[k], 0, sequences, c, offset))
            used[k] += repeats * c
            left[k] -= repeats * c
            offset += k * c
        sequences += repeats
        return repeats

    order = sorted(range(len(columns)), key=lambda p: (-counts[p], columns[p]))
    for p in order:
        fill(columns[p], int(counts[p]))
    # what rounding down left: the same columns again, largest solved counts first, then all columns of the lengths that are still there
    for p in order:
        fill(columns[p], max(left.values()))
    while columns := combinations(sorted(k for k, n in left.items() if n), window):
        if not sum([fill(column, max(left.values())) for column in columns]):
            break
    position = 0
    for k in sorted(left, reverse=True):
        if left[k]:
            placed[k].append((used[k], 1, position))
            position += left[k] * k
    whole, rest = divmod(position, window)
    cuts = [whole * window]
    for power in reversed(range(rest.bit_length())):
        if rest >> power & 1:
            cuts.append(cuts[-1] + (1 << power))
    return dict(placed), [sequences, *cuts]


def place(rank: int, length: int, placed: dict[int, list[tuple]], ends: list[int], window: int) -> list[tuple[int, int, int, int]]:
    """(start within the piece, length, sequence, offset) of what the piece is cut into."""
    own = placed[length]
    at = own[bisect.bisect_right(own, rank, key=lambda x: x[0]) - 1]
    if at[1] == 0:
        k, copy = divmod(rank - at[0], at[3])
        return [(0, length, at[2] + k, at[4] + copy * length)]
    begin, out, done = at[2] + (rank - at[0]) * length, [], 0
    first, whole, cuts = ends[0], ends[1], ends[1:]
    while done < length:
        p = begin + done
        if p < whole:
            low, high, number = p // window * window, (p // window + 1) * window, p // window
        else:
            k = bisect.bisect_right(cuts, p)
            low, high, number = cuts[k - 1], cuts[k], whole // window + k - 1
        n = min(length - done, high - p)
        out.append((done, n, first + number, p - low))
        done += n
    return out


def pack(docs: DataFrame, file: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = materialize(pieces(docs, file, window, end_id), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    # at most `window` rows, however many documents there are
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, ends = plan(histogram, window)
    shared = docs.sparkSession.sparkContext.broadcast((placed, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed, ends = shared.value
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "rank", "base", "body")]
            for doc_id, n_tokens, start, length, crc, rank, base, body in zip(*columns, strict=True):
                for lo, n, sequence, offset in place(base + rank, length, placed, ends, window):
                    out.append((doc_id, start + lo, n, crc if n == length else zlib.crc32(body[4 * lo : 4 * (lo + n)]), n_tokens, sequence, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names)

    ranked = made.join(bases.select("part", "length", "base"), ["part", "length"])
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
