import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import aggregates as ag
from quarry.operators import audit, filters, geometry, graph, joins, matching, registration, rules, sequences, spatial, statistics, voxels
from quarry.sources import lattice, meshes, tables, volumes


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_filter_rejects_bad_specs(spark):
    spec = filters.BoundedFilter
    for bad in (spec({"a": []}), spec({"a": ["x", "x"]}), spec({"b": ["x"]}), spec({}, {"n": (2, 1)}), spec(limit=501), spec({"a": ["z"]})):
        with pytest.raises(ValueError):
            bad.check(["a"], ["n"], {"a": ["x", "y"]})
    df = table(spark, [(1, 1.0), (2, float("nan")), (3, None)], "k int, n double")
    assert [r.k for r in filters.bounded(df, spec({}, {"n": (0, 5)}), ["k"])[0].collect()] == [1]
    assert filters.bounded(df, spec(), ["k"])[1].first()[0] == 3


def test_point_lookup(spark):
    df = table(spark, [(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert filters.point_lookup(df, "k", 1) == {"k": 1, "v": "a"}
    with pytest.raises(LookupError):
        filters.point_lookup(df, "k", 9)
    with pytest.raises(ValueError):
        filters.point_lookup(df, "k", 2)


def test_label_ladder(spark):
    rows = [("X_Designed_Removed",), ("possible_unintended_missing",), ("thin_like",), ("present_like",)]
    df = table(spark, rows, "s string")
    got = df.select(rules.substring_ladder(F.col("s"), rules.LABEL_LADDER, 1).alias("c")).collect()
    assert [r.c for r in got] == ["intentionally_removed", "missing", "thin", "present"]
    with pytest.raises(Exception, match="unknown label"):
        table(spark, [("zzz",)], "s string").select(rules.substring_ladder(F.col("s"), rules.LABEL_LADDER, 1)).collect()


def test_candidate_rules(spark):
    rows = [(0.2, 0.1, 1.0, 1.0), (0.8, 0.2, 1.0, 1.0), (0.95, 0.0, None, 1.0), (0.95, 0.0, 1.0, 0.5), (0.95, 0.0, 1.0, 1.0)]
    df = table(spark, rows, "occ double, gap double, align double, stab double")
    state = rules.coarse_state(F.col("occ"), F.col("gap"))
    label = rules.candidate_label(state, F.col("align"), F.col("stab"), F.lit(True), F.lit(3.0), F.lit(4.0), 5.0)
    got = df.select(label.alias("l"), rules.confidence_percent(label, F.col("stab"), F.col("occ"), F.col("align")).alias("c")).collect()
    assert [r.l for r in got] == ["missing", "broken", "uncertain", "uncertain", "thin"]
    assert got[0].c == 80.0 and got[2].c <= 50.0


def test_measurement_decision(spark):
    rows = [(0.9, 1.0, True, 0.0, 0.1, 0.1, 0.0), (0.5, 1.0, True, 0.0, 0.1, 0.1, 0.0), (0.9, 1.0, False, 0.0, 0.1, 0.1, 0.0), (0.82, 1.0, True, 0.0, 0.1, 0.1, 0.0)]
    df = table(spark, rows, "a double, g double, c boolean, r double, p double, q double, u double")
    d = rules.measurement_decision(*[F.col(c) for c in "agcrpqu"])
    got = df.select(d["has_error"].alias("e"), d["failed_checks"].alias("f")).collect()
    assert [(r.e, r.f) for r in got] == [(False, ""), (True, "axial_coverage"), (None, "continuity"), (None, "")]


def test_robust_and_modes(spark):
    df = table(spark, [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0), ("b", 9.0)], "g string, v double")
    out = {r.v for r in ag.robust_outliers(df, "g", "v").filter("outlier").collect()}
    assert out == {100.0}
    m = ag.mode(table(spark, [("u", "y"), ("u", "x"), ("u", None)], "g string, v string"), "g", "v").first()
    assert (m["mode"], m["votes"]) == ("x", 1)


def test_otsu_against_every_split(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(20, 3, 300), rng.normal(60, 5, 200)]).round().tolist()
    got = ag.otsu(ag.histogram(table(spark, [(v,) for v in values], "v double"), "v")).first()["threshold"]
    x = np.array(values)
    best = max(sorted(set(values))[:-1], key=lambda t: (round((x <= t).sum() * (x > t).sum() * (x[x <= t].mean() - x[x > t].mean()) ** 2, 6), -t))
    assert got == best


def test_overlap_of_empty_masks(spark):
    r = ag.overlap(table(spark, [(1,)], "v int"), F.col("v") > 5, F.col("v") > 5).first()
    assert (r.dice, r.iou, r.inside) == (1.0, 1.0, 1.0)


def test_longest_run_of_array(spark):
    df = table(spark, [([True, False, False, True, False, False],), ([True],), ([],)], "f array<boolean>")
    got = [r.r.asDict() for r in df.select(sequences.longest_run_of_array(F.col("f"), False).alias("r")).collect()]
    assert got == [{"start": 1, "length": 2}, {"start": -1, "length": 0}, {"start": -1, "length": 0}]


def test_joins(spark):
    left = table(spark, [(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        joins.chained(left, [(table(spark, [(1, "a"), (1, "b")], "k int, v string"), "k")])
    with pytest.raises(ValueError):
        joins.references_or_fail(left, "k", table(spark, [(1,)], "id int"), "id")
    a, b = table(spark, [(1, 1.0), (2, 2.0), (3, None)], "k int, v double"), table(spark, [(2, 2.5), (3, None), (4, 4.0)], "k int, v double")
    assert {r.key: r.state for r in joins.compare_tables(a, b, "k", "v", 0.1).collect()} == {1: "left_only", 2: "mismatch", 3: "equal", 4: "right_only"}
    assert joins.precision_recall(left.filter("k > 9"), left.filter("k > 9")).first()["recall"] == 1.0


def test_components_against_plain(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.connected_components(table(spark, edges + [(None, 1)], "src long, dst long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert graph.connected_components(table(spark, [], "src long, dst long")).count() == 0


def test_radius_pairs_and_knn(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(80, 3)).round(3)
    df = table(spark, [(i, *map(float, v)) for i, v in enumerate(p)] + [(99, None, 0.0, 0.0)], "id long, x double, y double, z double")
    want = {(i, j) for i, j in itertools.combinations(range(80), 2) if math.dist(p[i], p[j]) <= 0.7}
    assert {(r.a, r.b) for r in joins.radius_pairs(df, "id", ["x", "y", "z"], 0.7).collect()} == want
    vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(p)] + [(99, None)], "id long, v array<double>")
    got = {(r.source, r["rank"]): r.neighbour for r in joins.nearest(vectors.filter("id < 5"), vectors, "id", "v", 3).collect()}
    for s in range(5):
        order = sorted((round(math.dist(p[s], p[j]), 6), j) for j in range(80) if j != s)[:3]
        assert [got[s, k + 1] for k in range(3)] == [j for _, j in order]
    metrics = spatial.cluster_metrics(df.filter("id < 80"), "id", ["x", "y", "z"], 0.7).first()
    assert metrics.pairs == len(want)


def test_fisher_and_bh(spark):
    def plain(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
        return sum(p(x) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= p(a) * (1 + 1e-7))

    for t in [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (1, 1, 1, 1)]:
        assert statistics.fisher_two_sided(*t) == pytest.approx(plain(*t), rel=1e-9)
    q = {r.k: r.q for r in statistics.benjamini_hochberg(table(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double"), "p").collect()}
    assert q["a"] == pytest.approx(0.03) and q["b"] == pytest.approx(0.04) and q["c"] == pytest.approx(0.04) and q["d"] is None


def test_auc_by_pairs(spark):
    rows = [(1.0, 1), (2.0, 1), (2.0, 0), (0.5, 0), (None, 1), (None, 0)]
    df = table(spark, rows, "s double, y int")
    known = [(a, b) for a, y in rows for b, z in rows if y == 1 and z == 0 and a is not None and b is not None]
    won = sum(1.0 if a > b else 0.5 if a == b else 0 for a, b in known)
    assert statistics.auc(df, "s", F.col("y") == 1).first()["auc"] == pytest.approx(won / len(known))
    r = statistics.auc_bounds(df, "s", F.col("y") == 1).first()
    assert (r.lower, r.upper) == (pytest.approx(won / 9), pytest.approx((won + 9 - len(known)) / 9))
    assert statistics.auc(df.filter("y = 1"), "s", F.col("y") == 1).first()["auc"] is None


def test_assignment_is_least():
    rng = np.random.default_rng(2)
    for n, m in [(1, 1), (3, 5), (4, 4)]:
        cost = rng.random((n, m))
        got = sum(cost[i, c] for i, c in enumerate(matching.assignment(cost)))
        assert got == pytest.approx(min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n)))


def test_octet_template(spark):
    assert geometry.octet_nodes(spark, 9).count() == 3430
    assert geometry.octet_edges(spark, 9).count() == 18468


def test_fits(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 3))
    turn = registration.proper_cube_rotations()[7]
    b = 1.5 * a @ turn.T + [1, 2, 3]
    df = table(spark, [tuple(map(float, (*x, *y))) for x, y in zip(a, b, strict=True)], "x double, y double, z double, u double, v double, w double")
    fit = registration.similarity_fit(df, list("xyz"), list("uvw"))
    assert fit["scale"] == pytest.approx(1.5) and np.allclose(fit["rotation"], turn)
    assert np.allclose(registration.affine_fit(df, list("xyz"), list("uvw")), fit["matrix"])
    assert len(registration.proper_cube_rotations()) == 24
    assert np.allclose(registration.compose(fit["matrix"], registration.invert(fit["matrix"])), np.eye(4))


DOCUMENT = {"junctions": [{"id": k, "position": [float(k), 0, 0], "indices": [0, 0.5, 1]} for k in range(3)], "struts": [{"id": 0, "junction0": 0, "junction1": 1}, {"id": 1, "endpoints": [1, 2], "thickness": 0.5}], "unit_cells": [{"id": 0, "struts": [0, 1], "indices": [0, 0, 0]}]}


def test_lattice_documents(spark):
    text = json.dumps(DOCUMENT)
    j, s, c = lattice.parse_documents(table(spark, [(text,)], "value string"))
    assert j.count() == 3 and c.count() == 2
    assert sorted(r.length for r in lattice.strut_geometry(s, j).collect()) == [1.0, 1.0]
    broken = {**DOCUMENT, "struts": [{"id": 0, "junction0": 0, "junction1": 9}]}
    with pytest.raises(ValueError):
        lattice.parse_documents(table(spark, [(json.dumps(broken),)], "value string"))
    points, struts = lattice.salvage(table(spark, [(text[: text.index('"unit_cells"')] + "{{",)], "value string"))
    assert points.count() == 3 and struts.count() == 1


def test_sources(spark, tmp_path):
    volume = np.arange(4 * 5 * 6, dtype=np.uint16).reshape(4, 5, 6)
    np.save(tmp_path / "v.npy", volume)
    (tmp_path / "v.tif").write_bytes(volumes.write_tiff(volume))
    (tmp_path / "v_6x5x4_uint16.raw").write_bytes(volume.tobytes())
    assert volumes.npy_header((tmp_path / "v.npy").read_bytes())[0] == (4, 5, 6)
    for name in ("v.npy", "v.tif", "v_6x5x4_uint16.raw"):
        chunks = volumes.read_chunks(spark, str(tmp_path / name), size=3)
        assert chunks.count() == 8
        assert volumes.voxels(chunks, 100).count() == int((volume >= 100).sum())
        assert {r.value: r.n for r in volumes.histogram(chunks).collect()} == {float(v): 1 for v in volume.ravel()}
    t = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, 0, 0], [0, 0, 1], [1, 0, 0]], [[1, 0, 0], [0, 0, 1], [0, 1, 0]]], float)
    (tmp_path / "t.stl").write_bytes(meshes.write_stl(t))
    tri = meshes.read_triangles(spark, str(tmp_path / "t.stl"))
    assert tri.count() == 4
    assert abs(geometry.enclosed_volume(tri).first()["volume"]) == pytest.approx(1 / 6)
    assert voxels.surface_voxels(tri, 0.5).count() > 4
    ply = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n1 2 3\n"
    (tmp_path / "p.ply").write_text(ply)
    assert [r.z for r in meshes.read_points(spark, str(tmp_path / "p.ply")).orderBy("point").collect()] == [0.0, 3.0]
    files = {r.path: r.sha256 for r in tables.inventory(spark, str(tmp_path), "*.npy").collect()}
    assert files == {"v.npy": tables.digest_of(str(tmp_path / "v.npy"))}


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n')
    assert tables.read_strict_csv(spark, str(tmp_path / "a.csv"), ["k", "v"]).first()["v"] == "x\ny"
    with pytest.raises(ValueError):
        tables.read_strict_csv(spark, str(tmp_path / "a.csv"), ["k", "w"])
    (tmp_path / "l.json").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError):
        tables.read_json_document(spark, str(tmp_path / "l.json"))
    assert tables.canonical_json({"b": 1, "a": np.float64(2)}) == b'{"a":2.0,"b":1}\n'
    with pytest.raises(ValueError):
        tables.canonical_json({"a": float("nan")})
    at = str(tmp_path / "once")
    assert tables.write_once(at, b"x") and not tables.write_once(at, b"x")
    with pytest.raises(FileExistsError):
        tables.write_once(at, b"y")
    rows = table(spark, [(1,)], "k int")
    rows.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.append_rows(rows, str(tmp_path / "t"), "k")
    tables.append_rows(table(spark, [(2,)], "k int"), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(PermissionError):
        tables.within("/etc/passwd", [str(tmp_path)], [".csv"])


def cylinder(gap=False):
    z, y, x = np.ogrid[:41, :41, :41]
    solid = ((z - 20) ** 2 + (y - 20) ** 2 <= 4) & (x >= 5) & (x <= 35)
    if gap:
        solid = solid & ~((x >= 16) & (x <= 25))
    return np.where(solid, 1000, 100).astype(np.uint16)


def test_strut_measurement(spark):
    names = [x.split()[0] for x in volumes.CHUNK.split(", ")]
    rows = [row for k, g in (("whole", False), ("gap", True)) for row in volumes.chunked(cylinder(g), k, 64)]
    chunks = spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], volumes.CHUNK)
    struts = table(spark, [(1, "whole", 20.0, 20.0, 5.0, 20.0, 20.0, 35.0), (2, "gap", 20.0, 20.0, 5.0, 20.0, 20.0, 35.0), (3, "whole", 5.0, 5.0, 5.0, 5.0, 5.0, 35.0)], "strut_id long, vol string, start_z double, start_y double, start_x double, stop_z double, stop_y double, stop_x double")
    got = {r.strut_id: r for r in voxels.measure_struts(chunks, struts, 550.0).collect()}
    assert [got[k].coarse_state for k in (1, 2, 3)] == ["intact", "broken", "missing"]
    assert 3.5 < got[1].diameter_median < 6


def test_voxel_kernels(spark):
    mask = np.zeros((5, 5, 5), bool)
    mask[2, 2, :2], mask[3, 3, 2] = True, True
    mask[0, 0, 4] = True
    assert voxels.label_26(mask)[1] == 2 and voxels.bridged(mask, (2, 2, 0), (3, 3, 2))
    solid = np.zeros((7, 7, 7), bool)
    solid[1:6, 1:6, 1:6] = True
    assert voxels.distance_to_background(solid)[3, 3, 3] == 3.0
    line = table(spark, [(0, 0, x) for x in range(4)], "z int, y int, x int")
    assert sorted(r.neighbours for r in voxels.skeleton_degrees(line).collect()) == [1, 1, 2, 2]
    assert voxels.gaussian(np.full((5, 6), 3.0), 1.0) == pytest.approx(3.0)
    points = table(spark, [(0, 0.2, 0.2, 0.3), (1, 9.0, 9.0, 9.0)], "point long, x double, y double, z double")
    tri = table(spark, [(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "triangle long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    near = voxels.nearest_triangles(points, tri, 0.5).collect()
    assert [(r.point, round(r.distance, 6)) for r in near] == [(0, 0.3)]


def test_audit_states(spark):
    claimed = table(spark, [("a", 1, "x"), ("b", 1, "x"), ("../c", 1, "x"), ("d", 1, "x"), ("e", 2, "x")], "path string, size long, sha256 string")
    actual = table(spark, [("a", 1, "x"), ("d", 1, "y"), ("e", 1, "x"), ("f", 1, "x")], "path string, size long, sha256 string")
    got = {r.path: r.state for r in audit.manifest(claimed, actual).collect()}
    assert got == {"a": "ok", "b": "missing", "../c": "unsafe", "d": "hash", "e": "size", "f": "orphan"}
    v = audit.verdict(audit.report(audit.skipped(spark, "x"), audit.same_rows(claimed, claimed, "same"))).first()
    assert (v["pass"], v.skip, v.verdict) == (1, 1, "PASS")


def test_text_functions(spark):
    df = table(spark, [('{"a": {"b/c": [1, 2]}}', "E_N000003_N000012", "# T\n## Method\nbody\n\n## Next\nx")], "j string, e string, m string")
    r = df.select(tx.json_pointer(F.col("j"), "/a/b~1c/1").alias("v"), tx.parse_edge_id(F.col("e")).alias("e"), tx.heading_section(F.col("m"), "Method").alias("s"), tx.truthy(F.lit(" Yes ")).alias("t"), tx.piped(F.array(F.lit(2), F.lit(1), F.lit(2))).alias("p")).first()
    assert (r.v, r.e.u, r.e.v, r.s, r.t, r.p) == ("2", 3, 12, "body", True, "1|2")


def test_streaming_histogram(spark, tmp_path):
    from quarry.streaming import histograms

    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1.5D as v union all select timestamp'2024-01-01 00:20:00', 1.9D union all select timestamp'2024-01-01 05:00:00', 7.0D").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, v double").parquet(source)
    q = histograms.running_histogram(stream, "v").writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.value: r.n for r in spark.sql("select * from running").collect()} == {1.5: 1, 1.9: 1, 7.0: 1}
    batch, at = spark.range(3), str(tmp_path / "out")
    assert histograms.append_unique(batch, at, "id") == 3
    assert histograms.append_unique(batch, at, "id") == 0
