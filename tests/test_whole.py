"""Queries over whole tables: rows far from their start count too."""

import hashlib
import math
import random

from quarry.plans import catalogue


def test_knn_sources_are_spread_over_the_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, i % 3, [r.random() for _ in range(4)]) for i in range(450)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want = {}
    for i, own in single.items():
        near = sorted((round(math.dist(own, v), 6), j) for j, v in single.items() if j != i)[:5]
        want |= {(i, j): (d, k) for k, (d, j) in enumerate(near, 1)}
    got = {(x.source, x.neighbour): (x.distance, x["rank"]) for x in catalogue.QUERIES["knn_topk"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if k[0] % 100 == 0}
    shares = catalogue.QUERIES["knn_composition"](spark, str(tmp_path)).collect()
    assert {(x.source_class, x.sources) for x in shares} == {(0, 150), (1, 150), (2, 150)}
    for x in shares:
        assert x.mean_share == round(sum(i % 3 == x.source_class and j % 3 == x.target_class for i, j in want) / 750, 6)


def test_rows_past_the_prefixes_count(spark, tmp_path):
    r = random.Random(6)
    balances = {i: r.randint(0, 10_000) / 1.0 + (3000 if i >= 300 else 0) for i in range(500)}
    spark.createDataFrame(list(balances.items()), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    means = []
    for k in range(200):
        drawn = sorted(balances, key=lambda i: (hashlib.md5(f"9:{k}:{i}".encode()).hexdigest(), i))[:40]
        means.append(sum(balances[i] for i in drawn) / 40)
    [row] = catalogue.QUERIES["permutation_null"](spark, str(tmp_path)).collect()
    assert row.n == 200 and abs(row.null_mean - sum(means) / 200) < 1e-3
    assert row.p == round((1 + sum(m >= 5000 for m in means)) / 201, 6)

    parts = [(i, r.randint(1, 50)) for i in range(380, 430)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    cells = {}
    for i, size in parts:
        a, b = (i % 23, i % 17), (size % 29, size % 13)
        for t in range(21):
            cells.setdefault(tuple(round(x + (y - x) * t / 20) for x, y in zip(a, b, strict=True)), set()).add(i)
    want = {c: min(own) if len(own) == 1 else -1 for c, own in cells.items()}
    got = {(x.x, x.y): x.owner for x in catalogue.QUERIES["raster_ownership"](spark, str(tmp_path)).collect()}
    assert got == want and any(i >= 400 for i in got.values())

    lines = [(499, 1, 26.0, 0.05, 0.04), (500, 1, 24.0, 0.05, 0.04), (70_000, 2, 25.0, 0.06, 0.04), (70_000, 3, 25.0, 0.05, 0.04)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    bins = {(x.l_orderkey, x.l_linenumber): x.orientation for x in catalogue.QUERIES["orientation_bins"](spark, str(tmp_path)).collect()}
    assert bins.keys() == {x[:2] for x in lines} and bins[499, 1] == bins[500, 1] == "2:0:0" and bins[70_000, 2] == "0:2:0"


def test_links_by_any_line_count(spark, tmp_path):
    r = random.Random(8)
    lines = [(r.randrange(60), p, (p % 12) * 3 + r.randrange(3), float(r.choice([7, 50])), r.choice([0.0, 0.09])) for p in (r.randrange(40) for _ in range(120))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    component = {}
    for _, p, s, _, _ in lines:
        both = {component.get(p, p), component.get(s + 100000000, s + 100000000)}
        component |= {p: p, s + 100000000: s + 100000000} | component
        component = {k: min(both) if v in both else v for k, v in component.items()}
    got = {x.id: x.component for x in catalogue.QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    assert got == component and 1 < len(set(got.values())) < len(got)

    edges = sorted({x[:2] for x in lines})
    want = {(*a, *b) for a in edges for b in edges if a < b and (a[0] == b[0] or a[1] == b[1])}
    pairs = [(x.o1, x.p1, x.o2, x.p2) for x in catalogue.QUERIES["shared_node_pairs"](spark, str(tmp_path)).collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_gaps_end_with_the_table(spark, tmp_path):
    rows = [(k, "P" if k in (5000, 6003) else "F") for k in [*range(4990, 6000), 6003] if k not in (4995, 5500)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(x.o_orderkey for x in catalogue.QUERIES["id_gap"](spark, str(tmp_path)).collect())
    assert got == [4995, 5000, 5500, 6000, 6001, 6002, 6003]
    spark.createDataFrame([], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/none/orders.parquet")
    assert catalogue.QUERIES["id_gap"](spark, f"{tmp_path}/none").count() == 0
