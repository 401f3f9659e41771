"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets, and distributed union-find.

A document's set holds 64-bit hashes of its distinct word shingles. Equal sets form classes first, and only the member with
the smallest doc_id goes on. SuperMinHash: step j gives each element a rank j + r in a slot that its own permutation names
(a Fisher-Yates shuffle driven by the element's hash); a slot keeps its smallest rank, and a document stops once no later
rank can be smaller. BANDS bands of ROWS slots give candidate buckets: at a similarity of 0.8 all bands miss a pair with
probability (1 - 0.8^ROWS)^BANDS, under 4e-8. Buckets are never expanded into pairs: each member meets the bucket's
best known member; verified links are united; what one bucket still holds of different groups is looked at inside tasks: members that size and
signature leave without a partner drop out, buckets with the same members count once, and the rest is compared in blocks on full sets, where
only links that unite two groups are put out. A link counts only if 100 * intersection >= 80 * union on the full sets.

Defined cases: null text is empty; empty sets are linked with nothing, even one another; a null doc_id is linked with nothing and
comes back with component_id null and kept true; rows that repeat a doc_id come back once each, judged by their own text; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import chunks, give_back, id_and_text, key_filter, materialize, maybe_in, mix, release, segment_hashes, shuffle_partitions, table, text_buffer
from quarry.operators.graph import connected_components

BANDS, ROWS = 24, 3
SLOTS = BANDS * ROWS
#: Members of a block, where a bucket still holds different groups after all have met its best known member.
BLOCK = 1024
#: Shingles in such a block, and text of one numpy pass.
BLOCK_SHINGLES, PASS_BYTES = 500_000, 1 << 20
#: Bytes of units that a worker looks at together, and pairs of them in one numpy pass.
TOGETHER, PAIRS = 2 << 20, 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHINGLE = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)

def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of anything but ASCII white space, A-Z lower-cased), and each text's first word."""
    n = len(raw)
    raw = _LOWER[raw]
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return segment_hashes(raw, begin, end), np.searchsorted(begin, at)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    words, first = word_hashes(raw, at)
    m = max(0, len(words) - size + 1)
    all_of = np.zeros(m, np.uint64)
    for k in range(size):
        all_of += words[k : k + m] * _SHINGLE[k]
    all_of = mix(all_of)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(all_of[lo : hi - size + 1])
        elif hi > lo:  # the whole, shorter sequence
            yield mix((words[lo:hi] * _SHINGLE[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.full(1, hi - lo, np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The smallest rank of each slot; ranks are numbers step + fraction as 64-bit integers."""
    n = len(elements)
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    if not n:
        return least
    order: np.ndarray | None = None
    row = np.arange(n)
    drawn: list[np.ndarray] = []
    for j in range(slots):
        draw = mix(elements + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        swap = j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = swap
            drawn.append(swap)
        else:
            if order is None:  # the permutations so far, only for documents that need a second step
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (n, 1))
                order[:, 0], order[row, drawn[0]] = drawn[0], 0
            slot = order[row, swap].astype(np.int64)
            order[row, swap] = order[:, j]
            order[:, j] = slot
        rank = np.uint64(j) << np.uint64(32) | draw & np.uint64(0xFFFFFFFF)
        np.minimum.at(least, slot, rank)
        if int(least.max()) >> 32 <= j:  # every later rank is j + 1 at least
            break
    return least


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _fingerprints(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    if not len(elements):
        return 0, 0
    return int(elements.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(elements + np.uint64(3))).view(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two fingerprints of the set, its band keys, and eight bits of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, most=PASS_BYTES):
            n, one, two, keys, bits = [], [], [], [], []
            for elements in shingle_sets(*text_buffer(chunk["text"]), size):
                n.append(len(elements))
                a, b = _fingerprints(elements)
                one.append(a)
                two.append(b)
                signature = superminhash(elements)
                keys.append(band_keys(signature) if len(elements) else np.zeros(0, np.int64))
                bits.append(mix(signature).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), chunk["text_hash"].combine_chunks(), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "n_shingles", "one", "two", "keys", "bits"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, one long, two long, keys array<long>, bits binary")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), "text")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, most=PASS_BYTES):
            found = [x.view(np.int64) for x in shingle_sets(*text_buffer(chunk["text"]), size)]
            yield pa.RecordBatch.from_arrays([chunk["node"].combine_chunks(), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"])

    return docs.mapInArrow(run, "node long, elements array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b").distinct()


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members paired with its best known one: at most one pair a row.

    Best known is who shares most buckets: the original among its copies. Set sizes alone rule a pair out if the smaller set is too small."""
    best = members.groupBy("key").agg(F.max(F.struct("known", -F.col("node"), "node", "n")).alias("top")).select("key", F.col("top.node").alias("pivot"), F.col("top.n").alias("n_pivot"))
    pairs = members.join(best, "key").filter("node <> pivot").filter(100 * F.least("n", "n_pivot") >= percent * F.greatest("n", "n_pivot"))
    return pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def _units(open_members: DataFrame, block: int, shingles: int | None) -> DataFrame:
    """The members (key, node, component, n, ...) dealt to units of work (key, p, q); mine: the block of a member.

    A bucket's largest group and its other members are dealt to blocks; a block of the others with one of the largest group, or two blocks of the
    others, are one unit, so a large group costs no more than its few outsiders call for. shingles: in a block, at most (null: any number)."""
    of_group = open_members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    of_key = of_group.groupBy("key").agg(F.max(F.struct("size", "component", "total")).alias("main"), F.sum("size").alias("size"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    deal = lambda size, total: F.ceil(F.greatest(size / block, total / shingles) if shingles else size / block).cast("int")
    of_key = of_key.select("key", F.col("main.component").alias("main"), deal(F.col("main.size"), F.col("main.total")).alias("in_main"), deal(F.col("size") - F.col("main.size"), F.col("total") - F.col("main.total")).alias("outside"))
    # blocks of the largest group have numbers under 0; it is compared with the others only, the others with one another too
    dealt = open_members.join(of_key, "key")
    is_main, hashed = F.col("component") == F.col("main"), F.xxhash64("node")
    dealt = dealt.withColumn("mine", F.when(is_main, -1 - F.pmod(hashed, "in_main")).otherwise(F.pmod(hashed, "outside")).cast("int"))
    unit = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("mine")
    others = F.concat(F.transform(up_to("outside"), lambda o: unit(F.least(mine, o), F.greatest(mine, o))), F.transform(up_to("in_main"), lambda m: unit(-1 - m, mine)))
    dealt = dealt.withColumn("unit", F.explode(F.when(is_main, F.transform(up_to("outside"), lambda o: unit(mine, o))).otherwise(others)))
    return dealt.select("key", "unit.p", "unit.q", "mine", *[c for c in open_members.columns if c != "key"])


def _per_unit(units: DataFrame, work, shape: str) -> DataFrame:
    """work(rows of some whole units, in order of their units) in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            unit = [batch[c].to_numpy() for c in ("key", "p", "q")]
            edges = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in unit], axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                this = tuple(int(x[lo]) for x in unit)
                if this != last and size >= TOGETHER:
                    yield work(pa.Table.from_batches(held))
                    held, size = [], 0
                last = this
                held.append(batch.slice(lo, hi - lo))
                size += held[-1].nbytes
        if held:
            yield work(pa.Table.from_batches(held))
        give_back()

    spread = units.repartition(shuffle_partitions(units.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q", "mine")
    return spread.mapInArrow(run, shape)


def _alike(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit that size and signature allow a link between; of different groups only, some thousands at a time."""
    # fewer equal slots at the similarity asked for: 5 standard deviations, under one in a million
    least = int(SLOTS * percent / 100 - 5 * (SLOTS * percent / 100 * (1 - percent / 100)) ** 0.5)
    key, p, q, mine, component, n = (rows[c].to_numpy() for c in ("key", "p", "q", "mine", "component", "n"))
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(key), -1)
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0))))
    of = np.cumsum(np.bincount(edge, minlength=len(key))) - 1
    end = np.append(edge[1:], len(key))[of]
    # a unit's first block comes first; the second begins where `mine` is q, and is the same one where p is q
    begin = np.where(p == q, np.arange(len(key)) + 1, edge[of] + np.add.reduceat((mine == p).astype(np.int64), edge)[of])
    count = np.where(mine == p, np.maximum(end - begin, 0), 0)
    upto = np.concatenate(([0], np.cumsum(count)))
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        own = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        j = np.repeat(begin[lo:hi] - (np.cumsum(own) - own), own) + np.arange(len(i))
        fits = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[fits], j[fits]
        if len(i):
            fits = np.count_nonzero(bits[i] == bits[j], axis=1) >= least
            if fits.any():
                yield i[fits], j[fits]
        lo = hi


def _candidates(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """The members of units that have a partner there by size and signature: rows, not pairs."""
    found = np.zeros(len(rows), bool)
    for i, j in _alike(rows, percent):
        found[i] = found[j] = True
    return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[found]) for c in ("key", "node")], ["key", "node"])


def _compare(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links of units, on full sets; only those that unite two groups."""
    node, component, n = (rows[c].to_numpy() for c in ("node", "component", "n"))
    elements = rows["elements"].combine_chunks()
    offsets, flat = elements.offsets.to_numpy().astype(np.int64), elements.values.to_numpy().view(np.uint64)
    parent = {int(c): int(c) for c in np.unique(component)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for left, right in _alike(rows, percent):
        edges = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            i = int(left[lo])
            ours, own = flat[offsets[i] : offsets[i + 1]], int(component[i])
            for at in range(lo, hi, 64):
                some = [j for j in right[at : min(at + 64, hi)].tolist() if root(own) != root(int(component[j]))]
                if not some:
                    continue
                some = np.array(some)
                size = n[some]
                end = np.cumsum(size)
                pool = flat[np.repeat(offsets[some] - (end - size), size) + np.arange(end[-1])]
                place = np.minimum(np.searchsorted(ours, pool), len(ours) - 1)
                both = np.add.reduceat((ours[place] == pool).astype(np.int64), end - size)
                for j in some[100 * both >= percent * (size + n[i] - both)].tolist():
                    a, b = root(own), root(int(component[j]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((min(node[i], node[j]), max(node[i], node[j])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _further_links(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between groups that still meet in a bucket (key, node, n, component, bits); enough of them to unite what can be united.

    First the members that size and signature leave without a partner drop out, and buckets that then hold the same members count once; so full
    sets travel only where a link may be. Pairs are looked at inside a unit; only links that unite two groups leave it."""
    near = _per_unit(_units(open_members, BLOCK, None), lambda rows: _candidates(rows, percent), "key long, node long").distinct()
    left = materialize(near, "alike")
    held = left.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"))
    once = held.groupBy("size", "print").agg(F.min("key").alias("key")).select("key")
    members = materialize(left.join(once, "key").join(open_members, ["key", "node"]), "open")
    units = _units(members, BLOCK, BLOCK_SHINGLES).join(sets, "node")
    return _per_unit(units.select("key", "p", "q", "mine", "node", "component", "n", "bits", "elements"), lambda rows: _compare(rows, percent), "a long, b long").distinct()


def _groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    docs = id_and_text(docs)
    signed = materialize(signatures(docs, size), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("one", "two", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("one", "two", "n_shingles", "first.doc_id", "first.text_hash")
    firsts = filled.join(classes, ["one", "two", "n_shingles", "doc_id", "text_hash"]).dropDuplicates(["one", "two", "n_shingles", "doc_id", "text_hash"])
    # each class of equal sets is a node; doc_ids may be repeated
    nodes = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dealt = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = materialize(dealt.join(shared, "key").select("key", "node", "n"), "shared")
    known = members.groupBy("node").agg(F.count(F.lit(1)).alias("known"))
    # of rows that repeat a doc_id and text one is enough; the join has brought them together
    wanted = nodes.select("node", "doc_id", "text_hash").join(known, "node", "left_semi")
    texts = _hashed(docs).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    sets = materialize(full_sets(texts.select("node", "text"), size), "sets")
    pairs = materialize(_pivot_pairs(members.join(known, "node"), percent), "pairs")
    links = materialize(_verified(pairs, sets, percent), "links")
    groups = materialize(connected_components(links, "a", "b"), "groups")
    release(pairs)
    labelled = materialize(members.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    release(members)
    # what one bucket still holds of different groups
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    open_members = materialize(labelled.join(mixed, "key").join(nodes.select("node", "bits"), "node").select("key", "node", "n", "component", "bits"), "mixed")
    release(labelled)
    more = materialize(_further_links(open_members, sets, percent), "more")
    release(open_members, sets)
    if more.limit(1).count():
        release(groups)
        groups = materialize(connected_components(links.unionByName(more), "a", "b"), "groups")
    release(links, more)
    # of each component the smallest doc_id
    named = materialize(nodes.select("node", "doc_id").join(groups.withColumnRenamed("id", "node"), "node"), "named")
    least = materialize(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    labels = named.join(least, "component").select("node", "least")
    of_class = materialize(nodes.select("node", "one", "two", "n_shingles", "doc_id").join(labels, "node", "left").select("one", "two", "n_shingles", F.coalesce("least", "doc_id").alias("component")), "of-class")
    release(nodes, groups, named, least)
    out = signed.select("doc_id", "text_hash", "n_shingles", "one", "two").join(of_class, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. `size` words a shingle; links from `percent` similarity on."""
    return _groups(docs, size, percent).drop("text_hash")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one for each group stays (the smallest doc_id), with all their columns."""
    gone = materialize(_groups(docs, size, percent).filter("not kept").select("doc_id", "text_hash").distinct(), "gone")
    may, sure = maybe_in(docs, key_filter(gone, "doc_id", "text_hash"), F.col("doc_id").cast("long"), _text_hash(F.col("text")))
    asked = may.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), _text_hash(F.col("row.text")).alias("text_hash"))
    return asked.join(gone, ["doc_id", "text_hash"], "left_anti").select("row.*").unionByName(sure.select("row.*"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
c(doc_id, label) AS (SELECT u, u FROM e UNION SELECT e.v, c.label FROM c JOIN e ON e.u = c.doc_id),
m AS (SELECT doc_id, min(label) AS label FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.label, d.doc_id) AS component_id, d.doc_id = coalesce(m.label, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
