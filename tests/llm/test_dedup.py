import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import _util, exact_dedup, near_dedup, suffix_dedup
from tests.llm.plain import clashing, documents, near_components, normalised, sha, shingles, without_repeats


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa Ωmega naïve x".split()) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


# --- exact ----------------------------------------------------------------------------------------------------------------------


def test_exact_groups(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (3, None), (4, ""), (7, "A b"), (None, "a b"), (2, "a b"), (8, " \n "), (6, " "), (1, "a b")]
    got = exact_dedup.exact_groups(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    for r in got:
        match = next(t for t in groups if sha(t) == r.text_sha256 and r.doc_id in groups[t])
        keep = min(i for i in groups[match] if i is not None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[match]), r.doc_id == keep)
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_exact_dedup_keeps_columns(spark):
    df = clashing(documents(spark, [(1, "x"), (2, "x"), (3, "y"), (None, "x")]))
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_digest_collisions_are_told_apart(spark):
    """With a digest that always collides, byte verification must still give the right groups."""
    weak = lambda body: F.when(body == "z", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (1, "b"), (6, "z"), (None, "c")]
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(documents(spark, rows), weak).collect())
    assert got == [("1", 1, 2, True), ("1", 1, 3, True), ("2", 1, 3, False), ("3", 1, 2, False), ("4", 1, 3, False), ("5", 5, 2, True), ("6", 6, 1, True), ("None", 5, 2, False)]


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(keep[normalised(t)]), len(groups[normalised(t)]), i == keep[normalised(t)], sha(normalised(t))) for i, t in rows)


def exact_rows(spark, rows):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents(spark, rows)).collect())


def test_exact_groups_of_repeated_ids(spark):
    rows = [(0, "x x"), (1, "x x"), (1, "y")]
    assert exact_rows(spark, rows) == plain_exact(rows)
    assert sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()) == [(0, "x x"), (1, "y")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-2, 3)), st.one_of(st.none(), st.sampled_from(["", " ", "a", "a ", "a b", "a\t\nb", "b"]))), max_size=12))
def test_exact_groups_against_a_plain_version(spark, rows):
    assert exact_rows(spark, rows) == plain_exact(rows)


def test_filters_miss_no_key(spark, monkeypatch):
    """However small the filter, keys that are in it pass; with room enough most others do not."""
    keys = spark.range(0, 4000, 2).select(F.col("id").alias("k"))
    rows = spark.range(0, 8000).select(F.col("id").alias("k"), F.lit("x").alias("bits"))
    for most in (1 << 15, 1 << 27):
        monkeypatch.setattr(_util, "FILTER_BITS", most)
        may, sure = _util.maybe_in(rows, _util.key_filter(keys, "k"), F.col("k"))
        hit, miss = {r.row.k for r in may.collect()}, {r.row.k for r in sure.collect()}
        assert {*range(0, 4000, 2)} <= hit and not hit & miss and hit | miss == {*range(8000)} and len(hit) < 3000


def test_compaction_keeps_the_smallest(spark):
    a = spark.createDataFrame([(b"x", 5, 2), (b"y", 1, 1)], "digest binary, first_id long, n long")
    b = spark.createDataFrame([(b"x", 3, 1)], "digest binary, first_id long, n long")
    assert {bytes(r.digest): (r.first_id, r.n) for r in exact_dedup.compact(a, b).collect()} == {b"x": (3, 3), b"y": (1, 1)}


# --- near -----------------------------------------------------------------------------------------------------------------------


def near_rows():
    rows, r = [], random.Random(3)
    for base in range(6):
        text = prose(base, 120).split()
        for copy in range(8):
            w = list(text)
            for _ in range(copy):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 999)}"
            rows.append((base * 40 + copy * 3, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE Two"), (905, "one two three four five"), (906, "one two three four six"), (907, rows[3][1]), (908, "same " * 50), (909, "same " * 80)]
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups(spark, size):
    rows = near_rows()
    want, sizes = near_components(rows, size)
    got = near_dedup.near_groups(clashing(documents(spark, rows + [(None, rows[0][1]), rows[0]])), size).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_groups(documents(spark, []), size).count() == 0
    assert near_dedup.near_groups(documents(spark, [(1, None), (2, "")]), size).filter("kept").count() == 2


def test_near_groups_in_blocks(spark, monkeypatch):
    """Members that their bucket's best known member does not link are still found, in several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - 9 * i] + [f"t{j}" for j in range(9 * i)])) for i in range(14)]  # each links only to its neighbours
    want, _ = near_components(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(documents(spark, rows), 4).collect()}
    assert got == want and len(set(got.values())) < 14


def test_words_that_cheat_hashes_are_not_linked(spark):
    """Thue-Morse strings defeat hashes that sum powers modulo a power of two, whatever the base."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(documents(spark, rows), 4).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_dedup_of_repeated_ids(spark):
    text = prose(3, 80)
    rows = [(1, text), (2, text + " more"), (2, prose(9, 50)), (2, prose(9, 50)), (None, text)]
    got = sorted((str(r.doc_id), r.n_shingles > 60, str(r.component_id), r.kept) for r in near_dedup.near_groups(documents(spark, rows)).collect())
    assert got == [("1", True, "1", True), ("2", False, "2", True), ("2", False, "2", True), ("2", True, "1", False), ("None", True, "None", True)]
    left = near_dedup.near_dedup(clashing(documents(spark, rows))).select("doc_id", "text").collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [rows[0], *rows[2:]])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            n = 300
            both = int(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = near_dedup.superminhash(a), near_dedup.superminhash(b)
            errors.append((x == y).mean() - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert (near_dedup.superminhash(np.arange(3, dtype=np.uint64)) < np.iinfo(np.uint64).max).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t.", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, size):
    import pyarrow as pa

    from quarry.llm._util import text_buffer

    found = list(near_dedup.shingle_sets(*text_buffer(pa.array(texts)), size))
    want = [shingles(t, size) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


# --- repeated substrings -----------------------------------------------------------------------------------------------------------


def suffix_rows():
    r, rows = random.Random(5), []
    common = prose(99, 30)
    for i in range(48):
        text = {0: prose(i, r.randint(1, 150)), 1: prose(i, 10) + common + prose(i + 7, 10), 2: common, 3: "ab" * r.randint(10, 200) + prose(i, 3), 4: "a" * r.randint(1, 300) + "\0" * r.randint(0, 3), 5: rows[r.randrange(len(rows))][1] if rows else "x"}[i % 6]
        rows.append((i * 3 % 49, text))
    return rows + [(100, None), (101, ""), (102, common * 4), (103, "é" * 60), (104, "é" * 49 + "x")]


@pytest.mark.parametrize("hot", [8192, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = suffix_rows()
    want = without_repeats(rows)
    got = suffix_dedup.remove_repeats(clashing(documents(spark, rows + [(None, rows[2][1]), rows[5]])), with_text=True).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and bytes(r.kept).decode() == rows[2][1]
        else:
            kept, gone, n_spans = want[r.doc_id]
            assert (bytes(r.kept), r.n_removed, r.n_spans, r.kept_sha256) == (kept, gone, n_spans, sha(kept))
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [8192, 2])
def test_suffix_dedup_of_repeated_ids(spark, monkeypatch, hot):
    """Rows that repeat a doc_id with other texts are documents of their own, in the order of their texts' hashes."""
    import xxhash

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    text = prose(3, 60)
    rows = [(0, text), (1, text), (1, "short"), (1, prose(4, 40) + text + "!"), (2, None), (2, text[30:] + prose(5, 9)), (1, text)]
    order = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), seed=42)).view(np.int64)
    one = sorted({(i, order(t), t) for i, t in rows}, key=lambda x: x[:2])
    want = without_repeats([(k, t) for k, (_, _, t) in enumerate(one)])
    plain = sorted((i, *want[[x[::2] for x in one].index((i, t))]) for i, t in rows)
    got = suffix_dedup.remove_repeats(documents(spark, rows), with_text=True).collect()
    assert sorted((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got) == plain


def test_removed_bytes_by_route(spark):
    """Differing contexts of one anchor are told apart by sorted suffixes, equal ones by their hashes."""
    common = prose(7, 40)
    rows = [(i, prose(20 + i, 12) + common + prose(40 + i, 12)) for i in range(6)]
    routes = {r.route for r in suffix_dedup.repeated_spans(documents(spark, rows)).select("route").distinct().collect()}
    assert routes == {"equal contexts", "sorted suffixes"}


def test_deep_shallow_orders_suffixes():
    r = random.Random(1)
    for _ in range(30):
        strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))).encode() for _ in range(60)] + [b"a" * n for n in (20, 40, 40, 41, 60)]
        group = np.array([r.randint(0, 2) for _ in strings])
        order, common = suffix_dedup.deep_shallow(strings, group, 0)
        assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group.tolist(), strings, strict=True))
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            lcp = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert common[k] == (-1 if group[order[k]] != group[order[k - 1]] else lcp)


def test_very_long_text(spark):
    text = prose(1, 60_000)
    rows = [(1, text), (2, text[:3000] + " new"), (3, prose(2, 50))]
    want = without_repeats(rows)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()} == {i: w[1] for i, w in want.items()}
