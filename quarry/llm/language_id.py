"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features: hashed byte pairs and triples of the lower-cased letters of the whole text (anything else is one space), as
square roots of their shares, scaled to unit length. Training: documents whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not
null, sampled by a hash of doc_id and text to about PER_LANG different rows of each language; only their fixed-size feature vectors reach the
driver. Every language that occurs there is learned: one machine a family, one for each pair of a family's languages. A family's machine is trained against the other families; within a family each pair of languages has a machine of
its own, and the language with most votes wins (ties: the larger sum of margins, then the first by name).

Defined cases: text that is null or has no letter is `und` with score 0; where nothing can be learned every other text is
`und` too; a null doc_id is passed on and belongs to training (it has no checksum: remainder null counts as held in);
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import chunks, give_back, small_batches, table, text_buffer

#: Different rows of each language that training looks at (on average; a hash picks them).
PER_LANG = 400
WIDTH = 4096
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur"),
    "semitic": ("ar", "he"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    """A language that no family lists is a family of its own."""
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(byte: np.ndarray, doc: np.ndarray, most: int, width: int, size: int) -> np.ndarray:
    """Counts of hashed pairs and triples that start among the first `most` bytes, by text."""
    byte = byte.astype(np.uint32)
    same = doc[1:] == doc[:-1]
    pair = byte[:-1] << 8 | byte[1:]
    triple = pair[:-1] << 8 | byte[2:]
    row = doc.astype(np.int64) * width
    first = row[:-1] + ((pair * np.uint32(2654435761)) >> 21) % (width // 2)
    second = row[:-2] + width // 2 + ((triple * np.uint32(2246822519)) >> 20) % (width - width // 2)
    return np.bincount(np.concatenate([first[:most][same[:most]], second[:most][(same[1:] & same[:-1])[:most]]]), minlength=size)


def vectors(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row of unit length for each text (zeros where it has no letter)."""
    n = len(at) - 1
    out = np.zeros((n, width), np.float32)
    done = 0
    while done < n:
        # texts together, as long as their table of counts is small
        stop = int(np.searchsorted(at, at[done] + (1 << 20), "right")) - 1
        stop = min(max(stop, done + 1), done + 512, n)
        byte = _FOLD[raw[at[done] : at[stop]]]
        if len(byte):
            doc = np.repeat(np.arange(stop - done, dtype=np.int32), np.diff(at[done : stop + 1]))
            keep = np.ones(len(byte), bool)
            keep[1:] = (byte[1:] != 32) | (byte[:-1] != 32) | (doc[1:] != doc[:-1])
            byte, doc = byte[keep], doc[keep]
            counts = np.zeros((stop - done) * width, np.int64)
            for lo in range(0, len(byte), 1 << 20):  # a single long text is counted piece by piece
                counts += _counted(byte[lo : lo + (1 << 20) + 2], doc[lo : lo + (1 << 20) + 2], 1 << 20, width, len(counts))
            found = np.sqrt(counts.reshape(stop - done, width))
            size = np.sqrt((found * found).sum(1, keepdims=True))
            out[done:stop] = found / np.where(size > 0, size, 1)
        done = stop
    return out


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    found = np.zeros(len(at) - 1, bool)
    filled = np.flatnonzero(np.diff(at) > 0)
    if len(filled):  # these follow one another without gaps
        found[filled] = np.maximum.reduceat(ascii_letter.view(np.uint8), at[filled]) > 0
    for k in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[k] = any(c.isalpha() for c in raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, passes: int = 30, c: float = 10.0) -> np.ndarray:
    """Weights (the last is the bias) of an L2 support vector machine with squared hinge loss, by dual coordinate descent.

    y: +1 or -1. weight: of each row."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    soft = 1 / (2 * c * weight)
    norm = (x * x).sum(1) + soft
    order = np.random.default_rng(7)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + soft[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    #: for each family its languages, and for each pair of them (places) the machine that is positive for the first
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def of_texts(self, raw: np.ndarray, at: np.ndarray, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text, a few rows at a time: vectors are wide, and texts may be short and many."""
        parts = []
        for lo in range(0, len(at) - 1, rows):
            own = at[lo : lo + rows + 1]
            piece, own = raw[own[0] : own[-1]], own - own[0]
            lang, score = self.predict(vectors(piece, own))
            none = ~has_letter(piece, own)
            lang[none], score[none] = "und", 0.0
            parts.append((lang, score))
        lang, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, object), np.zeros(0))
        return lang, score.astype(np.float64)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.families:
            return np.full(len(x), "und", object), np.zeros(len(x))
        squash = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        margins = x @ self.family_weights[:-1] + self.family_weights[-1]
        best = margins.argmax(1)
        score = squash(margins[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        lang = np.empty(len(x), object)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.languages[family]
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for a, b, w in self.pairs[family]:
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
            won = (votes + 1e-6 * np.tanh(sums)).argmax(1) if len(rows) else np.zeros(0, int)
            lang[rows] = np.array(langs, object)[won]
            if len(langs) > 1 and len(rows):
                least = np.full(len(rows), np.inf)
                for a, b, w in self.pairs[family]:
                    m = x[rows] @ w[:-1] + w[-1]
                    least = np.where(won == a, np.minimum(least, m), np.where(won == b, np.minimum(least, -m), least))
                score[rows] *= squash(least)
        return lang, np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Balanced machines for families and for pairs of languages within each."""
    model = Model()
    if not len(x):
        return model
    lang = np.array(langs, object)
    family = np.array([family_of(v) for v in langs], object)
    model.families = sorted(set(family))

    def balanced(y: np.ndarray) -> np.ndarray:
        share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
        return 0.5 / share

    rows = []
    for f in model.families:
        y = np.where(family == f, 1.0, -1.0)
        rows.append(linear_svm(x, y, balanced(y)) if len(model.families) > 1 else np.append(np.zeros(x.shape[1]), 1.0))
    model.family_weights = np.array(rows).T.astype(np.float32)
    for f in model.families:
        model.languages[f] = own = sorted(set(lang[family == f]))
        model.pairs[f] = []
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                pick = (lang == own[a]) | (lang == own[b])
                y = np.where(lang[pick] == own[a], 1.0, -1.0)
                model.pairs[f].append((a, b, linear_svm(x[pick], y, balanced(y)).astype(np.float32)))
    return model


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learns from text and non-null lang of documents that are not held out, of which a hash of doc_id picks a bounded sample."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # rows that repeat id and text are one row, however many there are
    labelled = labelled.withColumn("row_hash", F.xxhash64("doc_id", "text", F.lit(11)))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("row_hash", 0.02).alias("n")).orderBy("lang").collect()
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_lang / max(1, r["n"])))])
    draw = F.pmod(F.col("row_hash"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).dropDuplicates(["lang", "row_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, most=1 << 20):
            raw, at = text_buffer(chunk["text"])
            x = [v for lo in range(0, len(at) - 1, 256) for v in vectors(raw[at[lo] : at[min(lo + 256, len(at) - 1)]], at[lo : lo + 257] - at[lo])]
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), chunk["lang"].combine_chunks(), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    sample = drawn.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, x binary").collect()
    sample.sort(key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"]), "<f2") for r in sample], np.float32).reshape(len(sample), WIDTH)
    return fit(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for chunk in chunks(batches, most=1 << 20):
            lang, score = model.of_texts(*text_buffer(chunk["text"]))
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), chunk["held_out"].combine_chunks(), pa.array(lang.tolist(), pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """Language and score of a text column, as a struct (lang, score); only the text travels to the workers."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            lang, score = shared.value.of_texts(*text_buffer(part))
            yield pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["lang", "score"])
        give_back()

    return F.arrow_udf(run, "lang string, score double")(F.coalesce(text.cast("string"), F.lit("")))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    return predict(docs, train(docs, per_lang))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
