import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry.operators.filters import BoundedFilter
from quarry.plans import inspection
from quarry.sources import lattice


@pytest.fixture(scope="module")
def chain(spark):
    """Seven junctions in a row, six struts, one row for each label."""
    junctions = spark.createDataFrame([(k, float(k), 0.5 * (k % 2), 0.25 * k) for k in range(7)], "id long, x double, y double, z double")
    struts = spark.createDataFrame([(k, k, k + 1) for k in range(6)], "id long, junction0 long, junction1 long")
    labels = ["designed_removed", "possible_unintended_missing", "possible_unintended_disconnected", "still_review_required", "low_priority_uncertain", "present_like"]
    rows = spark.createDataFrame([(f"E_N{k:06d}_N{k + 1:06d}", k, label) for k, label in enumerate(labels)], "edge_id string, source_strut_id long, phase2c_label string")
    return lattice.strut_geometry(struts, junctions), rows


def test_classified_edges(spark, chain):
    struts, labels = chain
    human = spark.createDataFrame([("E_N000001_N000002", "material_continuous")], "edge_id string, human_label string")
    got = {r.source_strut_id: r for r in inspection.classified_edges(labels, struts, human).collect()}
    assert [got[k]["group"] for k in range(6)] == ["intentional", "main", "main", "review_required", "low_priority_uncertain", "present"]
    assert got[1]["class"] == "missing" and got[1].adjudicated == "present" and got[2].adjudicated == "broken"
    assert got[1].name == "E_N000001_N000002"
    twice = human.union(spark.createDataFrame([("E_N000001_N000002", "missing")], human.schema))
    with pytest.raises(ValueError, match="disagree"):
        inspection.classified_edges(labels, struts, twice)


def test_clusters_and_baseline(spark, chain):
    struts, labels = chain
    edges = inspection.classified_edges(labels, struts)
    out = inspection.clusters(edges, [1.2])
    m = out["shared_metrics"].first()
    assert (m.components, m.largest, m.pairs) == (1, 2, 1)
    assert {r.id: r.cluster for r in out["radius_1.2"].collect()} == {1: 1, 2: 1}
    draws = inspection.random_baseline(edges, 40)
    assert draws.count() == 41 and draws.filter("replicate < 0").first()["pairs"] == 1
    s = inspection.baseline_summary(draws, "pairs").first()
    assert s.observed == 1 and 0 < s.p <= 1 and s.n == 40
    assert inspection.random_baseline(edges, 5, ["region_1"]).count() == 6
    near = inspection.neighbour_association(edges, 2)
    assert {(r.source_class, r.target_class): r.mean_share for r in near.collect()} == {("missing", "broken"): 0.5, ("broken", "missing"): 0.5}
    with pytest.raises(ValueError):
        inspection.neighbour_association(edges, 6)
    assert inspection.boundary_distribution(edges).filter("inferential").count() == 0


def test_results_service(spark, chain):
    struts, _ = chain
    own = inspection.strut_descriptors(struts.withColumnRenamed("id", "strut_id"))
    classes = spark.createDataFrame([(k, "missing" if k == 2 else "present", "accepted" if k else "review", 5.0, 4.0) for k in range(6)], "strut_id long, prediction string, classification_status string, longest_unsupported_gap_voxels double, length_voxels double")
    full = inspection.full_results(own, classes)
    service = inspection.Artifacts(full, metrics=("gap_fraction", "confidence_percent_uncalibrated"))
    rows, total = service.filter(BoundedFilter({"prediction": ["missing"]}, {"gap_fraction": (1.0, 1.0)}))
    assert [r.strut_id for r in rows.collect()] == [2] and total.first()[0] == 1
    assert service.details(0)["confidence_percent_uncalibrated"] == 30.0
    with pytest.raises(LookupError):
        service.details(99)
    with pytest.raises(ValueError):
        service.compare("secret", "gap_fraction")
    assert service.compare("prediction", "gap_fraction").count() == 2
    counts, cover = service.summary(["missing", "present", "thin"])
    assert {r.value: r.n for r in counts.collect()} == {"missing": 1, "present": 5, "thin": 0}
    assert cover.first()["rate_covered"] == 1.0
    assert {r.region for r in own.collect()} <= {"interior", "exterior"}


def octet(spark, cells):
    from quarry.operators import geometry

    nodes = sorted((r.i, r.j, r.k) for r in geometry.octet_nodes(spark, cells).collect())
    number = {n: k for k, n in enumerate(nodes)}
    edges = [(a, b) for a, b in combinations(nodes, 2) if math.dist(a, b) ** 2 == pytest.approx(2)]
    return nodes, number, edges


def test_damage_against_the_template(spark):
    nodes, number, edges = octet(spark, 2)
    gone_node, gone_edge = nodes[7], next(e for e in edges if nodes[7] not in e)
    kept = [n for n in nodes if n != gone_node]
    keyed = spark.createDataFrame([(number[n], *n) for n in kept], "id long, i long, j long, k long")
    struts = spark.createDataFrame([(k, number[a], number[b]) for k, (a, b) in enumerate(edges) if gone_node not in (a, b) and (a, b) != gone_edge], "id long, junction0 long, junction1 long")
    assert [tuple(r) for r in inspection.missing_nodes(spark, keyed, 2).collect()] == [gone_node]
    found = inspection.missing_edges(spark, keyed, struts, 2).collect()
    kinds = {frozenset((tuple(r.p), tuple(r.q))): r.kind for r in found}
    assert kinds == {frozenset(e): "anchor_missing" if gone_node in e else "record_deleted" for e in edges if gone_node in e or e == gone_edge}
    assert inspection.id_gaps(struts, len(edges) - 1).count() == len(kinds)
    junctions = keyed.select("id", (2 * F.col("i") + 1).cast("double").alias("x"), (F.col("j") * 3.0).alias("y"), (F.col("k") - F.col("i")).cast("double").alias("z"))
    m = inspection.lattice_to_space(keyed, junctions)
    assert m[0].tolist() == pytest.approx([2, 0, 0, 1]) and m[2].tolist() == pytest.approx([-1, 0, 1, 0])


def test_removed_by_design(spark):
    rows = [(k, r, 0.9 if k < 4 else 0.01 * (k % 5)) for k in range(200) for r in range(3)]
    df = spark.createDataFrame(rows, "strut long, radius int, d double")
    assert sorted(r.strut for r in inspection.removed_by_design(df, "strut", "radius", "d").collect()) == [0, 1, 2, 3]
    none = spark.createDataFrame([(k, r, 0.1 * (k % 9)) for k in range(200) for r in range(3)], df.schema)
    assert inspection.removed_by_design(none, "strut", "radius", "d").count() == 0
