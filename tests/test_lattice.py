"""Junctions, struts and evidence: what SQL cannot say, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import audit, integrity, joins, matching, statistics, voxels
from quarry.sources import meshes, tables, volumes


def test_matching_by_quality_and_nodes(spark):
    """Least cost over all ways to give controls, without those that share a node; ties fall as digests of the pairs say."""
    r = random.Random(3)
    rows = [("s", i, i < 2, float(r.randint(0, 4)), float(r.randint(0, 4)), r.random(), [i % 5, 10 + i % 3]) for i in range(7)]
    df = spark.createDataFrame(rows, "stratum string, id long, pos boolean, x double, y double, q double, nodes array<long>")
    got = matching.match_controls(df, "stratum", "id", "pos", ["x", "y"], 2, "q", "nodes").collect()
    yes, no = rows[:2], rows[2:]

    def cost(a, b):
        if set(a[6]) & set(b[6]):
            return math.inf
        return (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 + 0.1 * abs(a[5] - b[5])

    best = min(sum(cost(yes[k % 2], no[c]) for k, c in enumerate(way)) for way in itertools.permutations(range(5), 4))
    assert math.isclose(sum(x.cost for x in got), best, abs_tol=1e-9) and len(got) == 4
    by_id = {x[1]: x for x in rows}
    for p in (0, 1):
        own = [x for x in got if x.positive == p]
        assert [x.slot for x in sorted(own, key=lambda x: x.control)] == [0, 1]
        assert all(math.isclose(x.cost, cost(by_id[p], by_id[x.control])) for x in own)
    only = spark.createDataFrame([("s", 0, True, 0.0, 0.0, 0.0, [1]), ("s", 1, False, 0.0, 0.0, 0.0, [1])], df.schema)
    assert matching.match_controls(only, "stratum", "id", "pos", ["x", "y"], 1, "q", "nodes").count() == 0
    assert 0 <= matching.pair_fraction(1, 2) < 1 and matching.pair_fraction(1, 2) != matching.pair_fraction(2, 1)


def test_links_of_reports(spark):
    texts = spark.createDataFrame([(1, "# Verdict\n[a](x.md) [b](<y z.md>) [c](https://h/x) [d](#top)"), (2, "[a](gone.md) [a](gone.md) draft"), (3, None)], "id long, text string")
    files = spark.createDataFrame([("x.md",), ("y z.md",)], "path string")
    got = {x.id: x for x in audit.text_claims(texts, "id", "text", ["# Verdict"], ["draft"], {r"\[a\]": 1}, files).collect()}
    assert (got[1].status, got[1].loose_links, got[1].miscounted) == ("PASS", [], [])
    assert (got[2].status, got[2].loose_links, got[2].present, got[2].missing, got[2].miscounted) == ("FAIL", ["gone.md"], ["draft"], ["# Verdict"], [r"\[a\]"])
    assert got[3].status == "FAIL" and got[3].missing == ["# Verdict"]


def test_states_where_nothing_varies(spark):
    """Fewer than three peers are not compared; equal metrics are no outliers."""
    rows = [(1, 3, 3, 5.0), (2, 3, 3, 5.0), (3, 5, 5, 1.0), (4, 5, 5, 1.0), (5, 5, 5, 1.0), (6, 5, 4, 1.0), (7, 5, 5, 900.0), (8, 8, 8, None)]
    got = {x.id: (x.state, x.confidence, x.peers_compared) for x in integrity.junction_states(spark.createDataFrame(rows, "id long, expected int, supported int, m double"), "expected", "supported", ["m"]).collect()}
    assert got[1] == got[2] == ("good", 0.6, False) and got[3] == ("good", 0.75, True) and got[8] == ("good", 0.6, False)
    assert got[6] == ("junction_under_fused", 0.73, True)
    # the deviation serves where the median deviation is nothing: 900 lies 2 of them above the median
    assert got[7] == ("good", 0.75, True)


def test_gates_on_nothing(spark):
    empty = spark.createDataFrame([], "d double")
    [row] = integrity.alignment_gate(empty, "d").collect()
    assert (row.stations, row.found, row.reliable) == (0, 0.0, False)
    rows = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("c", None)], "o string, v double")
    assert [x.o for x in integrity.best_order(rows, "o", "v").collect()] == ["a"]


def test_columns_side_by_side(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(2, 5), (1, 6)], "k long, b int")
    assert sorted((x.k, x.a, x.b) for x in joins.zipped(a, b, "k").collect()) == [(1, "x", 6), (2, "y", 5)]
    with pytest.raises(Exception, match="no partner for 2"):
        joins.zipped(a, b.filter("k = 1"), "k").collect()


def test_pairs_and_components_without_pairs(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(12), r.randrange(12)) for i in range(25)] + [(100, 50, 51), (101, 50, 51), (102, 51, 50), (103, 60, 60)]
    edges = spark.createDataFrame(rows, "e long, u long, v long")
    pairs = {(a, b) for a, *p in rows for b, *q in rows if a < b and set(p) & set(q)}
    assert joins.shared_node_pair_count(edges, "e", "u", "v").first().pairs == len(pairs)
    component = {e: e for e, _, _ in rows}
    for _ in rows:
        for a, b in pairs:
            component[a] = component[b] = min(component[a], component[b])
    assert {x.e: x.component for x in joins.shared_node_components(edges, "e", "u", "v").collect()} == component


def test_uniform_points_fill_the_box(spark):
    points = statistics.uniform_points(spark, 200, [(0.0, 10.0), (5.0, 6.0)], 5).collect()
    assert len(points) == 1000 and len({(p.c0, p.c1) for p in points}) == 1000
    assert all(0 <= p.c0 < 10 and 5 <= p.c1 < 6 for p in points) and abs(sum(p.c0 for p in points) / 1000 - 5) < 0.3
    apart = {k: [(p.c0, p.c1) for p in points if p.replicate == k] for k in range(5)}
    want = {k: sum(math.dist(a, b) <= 0.2 for a, b in itertools.combinations(own, 2)) for k, own in apart.items()}
    assert {x.replicate: x.pairs for x in statistics.uniform_null(spark, 200, [(0.0, 10.0), (5.0, 6.0)], 0.2, 5).collect()} == want


def test_struts_that_no_chunk_holds_are_told(spark):
    volume = np.zeros((12, 12, 12))
    volume[:, 5:8, 5:8] = 1000.0
    schema = volumes.CHUNK
    chunks = spark.createDataFrame(list(volumes.chunked(volume, "v", 12)), schema)
    struts = spark.createDataFrame([(1, "v", 1.0, 6.0, 6.0, 10.0, 6.0, 6.0), (2, "v", 1.0, 6.0, 6.0, 40.0, 6.0, 6.0), (3, "w", 1.0, 6.0, 6.0, 10.0, 6.0, 6.0)], "strut_id long, vol string, start_z double, start_y double, start_x double, stop_z double, stop_y double, stop_x double")
    got = {x.strut_id: x for x in voxels.measure_struts(chunks, struts, 500.0).collect()}
    assert got[1].coarse_state == "intact" and got[1].occupancy == 1.0
    assert got[2].coarse_state == got[3].coarse_state == "not covered" and got[2].occupancy is None


def test_nearest_triangles_against_dense_samples(spark):
    r = np.random.default_rng(2)
    triangles, points = r.uniform(0, 6, (20, 3, 3)), r.uniform(0, 6, (30, 3))
    weights = np.array([(a / 40, b / 40, 1 - (a + b) / 40) for a in range(41) for b in range(41 - a)])
    dense = np.linalg.norm(points[:, None, None] - (weights @ triangles)[None], axis=3).min(2)
    t = spark.createDataFrame([(k, *x.ravel().tolist()) for k, x in enumerate(triangles)], "triangle long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    p = spark.createDataFrame([(k, *x.tolist()) for k, x in enumerate(points)], "point long, x double, y double, z double")
    got = {x.point: x for x in voxels.nearest_triangles(p, t, 1.5).collect()}
    for k in range(30):
        if dense[k].min() < 1.4:
            assert dense[k].min() - 0.12 <= got[k].distance <= dense[k].min() + 1e-9
    assert set(got) <= {k for k in range(30) if dense[k].min() < 1.62}


def test_array_files(spark, tmp_path):
    a, b = np.arange(24, dtype=">i4").reshape(2, 3, 4), np.array([1.5, 2.5])
    assert np.array_equal(volumes.parse_npy(volumes.write_npy(a)), a)
    np.savez(tmp_path / "one.npz", a=a, b=b)
    found = volumes.parse_npz((tmp_path / "one.npz").read_bytes(), ["b", "a"])
    assert np.array_equal(found["a"], a) and np.array_equal(found["b"], b)
    with pytest.raises(ValueError, match="arrays are"):
        volumes.parse_npz((tmp_path / "one.npz").read_bytes(), ["a"])
    rows = {x["name"]: x for x in volumes.read_bundles(spark, str(tmp_path / "one.npz")).collect()}
    assert rows["a"]["shape"] == [2, 3, 4] and np.array_equal(np.frombuffer(rows["a"]["data"], rows["a"]["dtype"]).reshape(2, 3, 4), a)


def test_ply_files():
    points, faces = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3]], float), np.array([[0, 1, 2], [0, 1, 3]])
    data = meshes.write_ply(points, faces)
    assert meshes.ply_header(data) == {"vertex": 4, "face": 2}
    assert np.array_equal(meshes.parse_ply_points(data).to_numpy(), points)
    with pytest.raises(ValueError):
        meshes.ply_header(b"plx\nend_header\n")


def test_written_tables_keep_their_contract(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak"), (3, "")], "k long, t string")
    tables.write_csv(df, str(tmp_path / "c"), ["t", "k"])
    back = tables.read_strict_csv(spark, str(tmp_path / "c"), ["t", "k"])
    assert sorted((x.k, x.t or "") for x in back.collect()) == [("1", 'a "q", b'), ("2", "line\nbreak"), ("3", "")]
    with pytest.raises(ValueError, match="columns are"):
        tables.write_csv(df, str(tmp_path / "d"), ["k"])
    with pytest.raises(Exception, match="not a finite number"):
        tables.write_json_lines(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="already there"):
        spark.createDataFrame([(1,)], "k long").write.parquet(str(tmp_path / "p"))
        tables.append_rows(spark.createDataFrame([(1,)], "k long"), str(tmp_path / "p"), "k")


def test_channels(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1, 2.0), (0, 0, 0, 0, 3.0), (0, 0, 1, 1, 4.0)], "z int, y int, x int, c int, v double")
    merged = volumes.merged_channels(cells, "c", ["r", "g"])
    assert sorted((x.x, x.r, x.g) for x in merged.collect()) == [(0, 3.0, 2.0), (1, None, 4.0)]
    assert sorted(map(tuple, volumes.split_channels(merged, ["r", "g"]).select("z", "y", "x", "c", "v").collect())) == sorted(map(tuple, cells.collect()))
    assert volumes.cropped(cells, (0, 0, 1), (1, 1, 2)).select("x", "v").collect() == [(0, 4.0)]
    assert volumes.plane(cells, "x", 1).select(F.sum("v")).first()[0] == 4.0


@pytest.mark.parametrize("most", [-1, 1 << 62])
def test_quantiles_by_ranks(spark, monkeypatch, most):
    from quarry.operators import aggregates

    monkeypatch.setattr(aggregates, "BUFFER_BYTES", most)

    r = random.Random(9)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for values in ([5.0], [1.0, 2.0], [3.0] * 50, [r.gauss(0, 1) for _ in range(3000)], [float(r.randint(0, 5)) for _ in range(400)], [1e9, *[r.random() for _ in range(500)]], [-math.inf, 0.0, 1.0]):
        rows = [(v,) for v in values] + [(None,), (float("nan"),)]
        [row] = aggregates.quantiles(spark.createDataFrame(rows, "x double").repartition(3), "x", shares).collect()
        if values[0] > -math.inf:
            assert np.allclose(row.q, np.quantile(values, shares), rtol=1e-12, atol=1e-12)
    [row] = aggregates.quantiles(spark.createDataFrame([(None,)], "x double"), "x", shares).collect()
    assert row.q == []
    rows = [(g, r.gauss(0, 1)) for g in ("a", "b", None) for _ in range(300)] + [("c", 7.0), ("d", None), ("a", float("nan"))]
    got = {x.g: x.q for x in aggregates.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), "x", shares, "g").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for h, x in rows if h == g and x == x], shares), rtol=1e-12, atol=1e-12)
    compared = {x.g: (x.n, x.median) for x in aggregates.group_compare(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert compared["d"] == (1, None) and compared["c"] == (1, 7.0) and compared[None] == (300, got[None][3])
    [row] = aggregates.profile(spark.createDataFrame([(None,)], "x double"), "x").collect()
    assert (row.n, row.missing, row.p50) == (1, 1, None)


def test_labels_by_runs():
    r = np.random.default_rng(4)
    for shape, share in (((1, 1, 1), 1.0), ((3, 4, 5), 0.4), ((6, 7, 8), 0.25), ((5, 5, 5), 0.0), ((2, 9, 9), 0.6)):
        mask = r.random(shape) < share
        labels, n = voxels.label_26(mask)
        cells = {tuple(c) for c in np.argwhere(mask)}
        seen, count = set(), 0
        for seed in sorted(cells):
            if seed in seen:
                continue
            count += 1
            todo, own = [seed], {seed}
            while todo:
                c = todo.pop()
                for d in itertools.product((-1, 0, 1), repeat=3):
                    at = tuple(a + b for a, b in zip(c, d, strict=True))
                    if at in cells and at not in own:
                        own.add(at)
                        todo.append(at)
            assert {labels[c] for c in own} == {count}
            seen |= own
        assert n == count and (labels[~mask] == 0).all()
        far = voxels.distance_to_background(mask)
        outside = np.argwhere(~mask)
        if len(outside):
            assert all(math.isclose(far[c], np.linalg.norm(outside - np.array(c), axis=1).min()) for c in cells)


def test_mask_components_across_chunks(spark):
    r = np.random.default_rng(6)
    mask = r.random((6, 9, 150)) < 0.12
    mask[2, 3, 10:140] = True  # a run over several slices
    labels, _ = voxels.label_26(mask)
    cells = spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(mask)], "z long, y long, x long")
    want = {tuple(map(int, c)): int((labels == labels[tuple(c)]).sum()) for c in np.argwhere(mask)}
    names = {tuple(map(int, c)): tuple(map(int, np.argwhere(labels == labels[tuple(c)])[0])) for c in np.argwhere(mask)}
    for least in (1, 4):
        got = voxels.mask_components(cells, least).collect()
        assert {(c.z, c.y, c.x): (c["size"], tuple(c.component)) for c in got} == {c: (n, names[c]) for c, n in want.items() if n >= least}


def test_compressed_pages():
    """A deflated page with differences, a packed one and a plain one; one page alone can be read."""
    import struct
    import zlib

    pages = [np.arange(12, dtype="<u2").reshape(3, 4) * 7, np.full((2, 5), 9, "u1"), np.arange(6, dtype="<u2").reshape(2, 3)]
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page, code in zip(pages, (8, 32773, 1), strict=True):
        raw = np.diff(page, axis=1, prepend=page.dtype.type(0)).astype(page.dtype) if code == 8 else page
        data = {8: zlib.compress(raw.tobytes()), 32773: b"".join(bytes([257 - page.shape[1], 9]) for _ in range(page.shape[0])), 1: raw.tobytes()}[code]
        offset = len(body)
        body += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.dtype.itemsize * 8), (259, 3, code), (273, 4, offset), (279, 4, len(data)), (317, 3, 2 if code == 8 else 1), (339, 3, 1)]
        body[link : link + 4] = struct.pack("<I", len(body))
        body += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(body)
        body += b"\0\0\0\0"
    read = list(volumes.tiff_pages(bytes(body)))
    assert len(read) == 3 and all(np.array_equal(a, b) for a, b in zip(read, pages, strict=True))
    [one] = volumes.tiff_pages(bytes(body), only=1)
    assert np.array_equal(one, pages[1])


def test_radii_of_reports():
    from quarry.operators import spatial

    assert spatial.primary_radius([2.28, 4.56, 6.84], 4.5) == 4.56 and spatial.primary_radius([4.0, 5.0], 4.5) == 4.0
    assert spatial.null_radius([2.28, 4.56, 6.84]) == 4.56 and spatial.null_radius([3.0]) == 3.0


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_near_components_against_all_pairs(spark, monkeypatch, axes):
    """Sparse points, dense heaps, points at the very distance, with and without the look at what is known already."""
    from quarry.operators import spatial

    r = random.Random(axes)
    points = [tuple(r.uniform(0, 6) for _ in range(axes)) for _ in range(40 if axes < 3 else 80)]
    points += [tuple(c + r.uniform(0, 0.3) for c in heap) for heap in ((1.0,) * axes, (4.0,) * axes) for _ in range(25)]
    points += [(10.0,) + (0.0,) * (axes - 1), (10.5,) + (0.0,) * (axes - 1), (11.0 + 1e-9,) + (0.0,) * (axes - 1)]
    rows = [(k, *p) for k, p in enumerate(points)] + [(900, *[None] * axes), (901, *[float("nan")] * axes)]
    names = [f"x{k}" for k in range(axes)]
    component = {k: k for k in range(len(points))}
    near = [(i, j) for i in component for j in component if i < j and math.dist(points[i], points[j]) <= 0.5]
    for _ in range(30):
        for i, j in near:
            component[i] = component[j] = min(component[i], component[j])
    want = {i: component[i] for pair in near for i in pair}
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    for most in (5_000_000, 0):
        monkeypatch.setattr(spatial, "OPEN_PAIRS", most)
        assert {x.id: x.component for x in spatial.near_components(df, "id", names, 0.5).collect()} == want
    assert {x.id for x in spatial.dbscan(df, "id", names, 0.5).filter("cluster = -1").collect()} == {r[0] for r in rows} - set(want)
