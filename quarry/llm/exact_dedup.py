"""Exact deduplication by a log-structured merge index of content digests (DataFrame functions only).

Memtables: each task that reads documents flushes what it read as one run, a Parquet file of (run, digest, doc_id) sorted by digest,
with filters and min/max statistics on the digest; nothing is shuffled for that. Compaction merges FAN_IN runs to one of the next
level, and these to the last level: of equal digests the smallest identifier stays and counts add up. Each level is stored as sorted
runs of its own. A probe asks the filter of the last level's repeated digests first (a bitmap of a bounded size): most rows of groups of one
end there and are not shuffled, the others meet the level itself. Every hit is compared byte for byte with
the text that it would be dropped for; a second filter, on the hits' identifiers, keeps other texts out of the shuffle. Where digests
agree and bytes do not, that digest's rows are grouped anew by their full text.

Defined cases: null text is empty text; empty texts are equal to one another; a null doc_id never keeps a group unless all
its ids are null; rows may repeat a doc_id with the same or other texts: each is judged by its own text, and rows that repeat the
keeper's doc_id and text are all kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import id_and_text, key_filter, materialize, maybe_in, release, table

#: A white space run that is not yet one space.
_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Runs that one compaction merges.
FAN_IN = 4
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true"}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, _RUN, " ")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def flush(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Level 0: each task's memtable as a sorted run."""
    rows = docs.select(F.spark_partition_id().alias("run"), digest(normalised(F.col("text"))).alias("digest"), "doc_id")
    return materialize(rows.sortWithinPartitions("digest", "doc_id"), "level-0", **_BLOOM)


def next_level(runs: DataFrame) -> DataFrame:
    """Level 1: FAN_IN runs merged to one, (run, digest, first_id, n), sorted."""
    dealt = runs.select(F.floor(F.col("run") / FAN_IN).cast("int").alias("run"), "digest", "doc_id")
    merged = dealt.groupBy("run", "digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return materialize(merged.sortWithinPartitions("run", "digest"), "level-1", **_BLOOM)


def compact(*levels: DataFrame) -> DataFrame:
    """Merge levels: the smallest identifier and the number of rows of each digest."""
    merged = levels[0].select("digest", "first_id", "n")
    for level in levels[1:]:
        merged = merged.unionByName(level.select("digest", "first_id", "n"))
    return merged.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))


def probe(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row; both null for rows that no group of several holds."""
    may, sure = maybe_in(runs.select("doc_id", "digest"), key_filter(groups, "digest"), F.col("digest"))
    nobody = sure.select("row.*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    return may.select("row.*").join(groups, "digest", "left").select("doc_id", "digest", "keep_id", "group_size").unionByName(nobody)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. digest: of a normalised text."""
    docs = id_and_text(docs)
    runs = flush(docs, digest)
    level = next_level(runs)
    index = materialize(compact(level).sortWithinPartitions("digest"), "level-2", **_BLOOM)
    release(level)
    groups = materialize(index.filter("n > 1").select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")), "groups")
    probed = materialize(probe(runs, groups), "probed")
    release(runs, index)
    texts = _hits(docs, probed, groups, digest)
    odd = _unverified(texts)
    if odd.limit(1).count():
        theirs = texts.join(odd, "digest")
        regrouped = theirs.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = theirs.select("doc_id", "digest", "body").join(regrouped, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size")
        probed = probed.join(odd, "digest", "left_anti").unionByName(again)
    else:
        release(texts, groups)
    return _result(probed)


def _hits(docs: DataFrame, probed: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest, keep_id and body (the normalised text) of every row in a group of several. Other texts do not travel."""
    hits = probed.filter("group_size is not null")
    may, _ = maybe_in(docs, key_filter(hits, "doc_id"), F.col("doc_id"))
    bodies = may.select("row.doc_id", normalised(F.col("row.text")).alias("body"))
    return materialize(bodies.withColumn("digest", digest(F.col("body"))).join(groups, "digest").select("doc_id", "digest", "keep_id", "body"), "hits")


def _unverified(texts: DataFrame) -> DataFrame:
    """Digests of hits whose bytes differ from the text that they would be dropped for; none, as long as SHA-256 holds."""
    # stored, so that the join has two plain exchanges and a large group of hits can be split; one row for each digest, so no pairs are made
    keepers = materialize(texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("kept_body")), "keepers")
    return texts.select("digest", "body").join(keepers, "digest").filter("body <> kept_body").select("digest").distinct()


def _result(probed: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return probed.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows with a null doc_id stay. Rows that certainly stay are not shuffled."""
    gone = materialize(exact_groups(docs).filter("not kept and doc_id is not null").select("doc_id", "text_sha256").distinct(), "gone")
    may, sure = maybe_in(docs, key_filter(gone, "doc_id"), F.col("doc_id").cast("long"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    asked = may.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.lower(F.hex(sha256(normalised(text)))).alias("text_sha256"))
    return asked.join(gone, ["doc_id", "text_sha256"], "left_anti").select("row.*").unionByName(sure.select("row.*"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
