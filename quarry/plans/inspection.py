"""Whole analyses of a lattice: results assembly and lookups, clustering with null models, damage against the template."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import aggregates as ag
from quarry.operators import filters, geometry, graph, joins, registration, rules, sequences, spatial, statistics

AXES = ("x", "y", "z")

# --- results ------------------------------------------------------------------------------------------------------------------


def strut_descriptors(geometry_rows: DataFrame) -> DataFrame:
    """Struts with region (interior, exterior), height band and orientation, from lattice.strut_geometry."""
    ends = geometry_rows.select(*[F.least(f"{c}0", f"{c}1").alias(f"lo_{c}") for c in AXES], *[F.greatest(f"{c}0", f"{c}1").alias(f"hi_{c}") for c in AXES])
    box = ends.agg(*[F.min(f"lo_{c}").alias(f"min_{c}") for c in AXES], *[F.max(f"hi_{c}").alias(f"max_{c}") for c in AXES])
    at = geometry_rows.crossJoin(F.broadcast(box))
    n = {c: (F.col(f"mid_{c}") - F.col(f"min_{c}")) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)) for c in AXES}
    region = F.when(geometry.exterior([F.coalesce(n[c], F.lit(0.5)) for c in AXES]), "exterior").otherwise("interior")
    delta = [F.col(f"{c}1") - F.col(f"{c}0") for c in reversed(AXES)]
    return at.select(*geometry_rows.columns, region.alias("region"), geometry.height_band(F.coalesce(n["z"], F.lit(0.0))).alias("height_band"), geometry.orientation_key(delta).alias("orientation"))


def full_results(struts: DataFrame, classification: DataFrame, measurement: DataFrame | None = None, metrology: DataFrame | None = None, key: str = "strut_id") -> DataFrame:
    """One row for each strut: descriptors, classification, and measurements where there are any."""
    sides = [(classification, key), *[(side, key) for side in (measurement, metrology) if side is not None]]
    out = joins.chained(struts, sides)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if {"longest_unsupported_gap_voxels", "length_voxels"} <= set(out.columns):
        out = out.withColumn("gap_fraction", clip(F.col("longest_unsupported_gap_voxels") / F.nullif(F.col("length_voxels"), F.lit(0.0))))
    if "classification_status" in out.columns:
        status = F.lower("classification_status")
        out = out.withColumn("confidence_percent_uncalibrated", F.when(status == "accepted", 100.0).when(status == "confirmed", 75.0).when(status == "review", 30.0).otherwise(0.0))
    if "tiff_measurement_valid" in out.columns:
        out = out.withColumn("threshold_stability", F.when(F.col("tiff_measurement_valid"), 1.0).otherwise(0.0))
    return out


@dataclass(frozen=True)
class Artifacts:
    """Typed questions to a results table: filters, groups, one strut, a summary."""

    table: DataFrame
    key: str = "strut_id"
    label: str = "prediction"
    groups: Sequence[str] = ("prediction", "region", "height_band", "orientation")
    metrics: Sequence[str] = ("occupancy", "gap_fraction", "diameter_median_um", "threshold_stability", "confidence_percent_uncalibrated")
    private: Sequence[str] = ()

    def filter(self, spec: filters.BoundedFilter) -> tuple[DataFrame, DataFrame]:
        spec.check(self.groups, self.metrics)
        rows, total = filters.bounded(self.table, spec, [self.key])
        return rows.drop(*self.private), total

    def compare(self, group: str, metric: str) -> DataFrame:
        return ag.group_compare(self.table, filters.allowed(group, self.groups, "group"), filters.allowed(metric, self.metrics, "metric"))

    def details(self, value) -> dict:
        row = filters.point_lookup(self.table.drop(*self.private), self.key, value)
        return {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}

    def summary(self, domain: Sequence[str], open_labels: Sequence[str] = ("uncertain", "bent_or_misaligned", "not_applicable")) -> tuple[DataFrame, DataFrame]:
        """Counts over the label domain, and one row with the share that has a firm label."""
        firm = ~F.col(self.label).isin(list(open_labels))
        return ag.value_counts(self.table, self.label, domain), ag.rates(self.table, {"covered": firm})


# --- clusters -------------------------------------------------------------------------------------------------------------------


def classified_edges(labels: DataFrame, struts: DataFrame, human: DataFrame | None = None, cell: float = 1.0, cells: int = 9, widths: Sequence[float] = (0.5, 1.0, 1.5)) -> DataFrame:
    """Edges with class and group by the label ladder, the reviewer's class beside it, distances and regions.

    labels: edge_id, source_strut_id, phase2c_label; struts: lattice.strut_geometry; human: edge_id, human_label. Two reviewers who disagree
    about an edge are an error."""
    raw = F.col("phase2c_label")
    out = joins.unique_or_fail(labels, "edge_id").withColumn("class", rules.substring_ladder(raw, rules.LABEL_LADDER, 1)).withColumn("group", rules.substring_ladder(raw, rules.LABEL_LADDER, 2))
    if human is not None:
        if not joins.conflicting_labels(human, "edge_id", "human_label").isEmpty():
            raise ValueError("reviewers disagree")
        out = out.join(human.select("edge_id", "human_label").distinct(), "edge_id", "left")
        out = out.withColumn("adjudicated", rules.remapped(F.col("human_label"), {k: v[0] for k, v in rules.HUMAN_LABELS.items()}, F.col("class")))
    else:
        out = out.withColumn("adjudicated", F.col("class"))
    at = joins.unique_or_fail(struts, "id").withColumnRenamed("id", "source_strut_id")
    joins.references_or_fail(out, "source_strut_id", at, "source_strut_id")
    out = out.join(at, "source_strut_id")
    box = struts.agg(*[F.min(F.least(f"{c}0", f"{c}1")).alias(f"min_{c}") for c in AXES], *[F.max(F.greatest(f"{c}0", f"{c}1")).alias(f"max_{c}") for c in AXES])
    out = out.crossJoin(F.broadcast(box))
    mid, low, high = ([F.col(f"{p}_{c}") for c in AXES] for p in ("mid", "min", "max"))
    for w in widths:
        out = out.withColumn(f"region_{w:g}", geometry.boundary_region(mid, low, high, w * cell))
    for name, c in geometry.face_distances(mid, low, high).items():
        out = out.withColumn(f"distance_{name}", c)
    core: Column = F.lit(True)
    for m, lo, hi in zip(mid, low, high, strict=True):
        core = core & (F.abs(m - (lo + hi) / 2) <= 1.5 * cell + 1e-9)
    out = out.withColumn("core", core).withColumn("build_index", geometry.layer(F.col("mid_z"), F.col("min_z"), cell, cells))
    delta = [F.col(f"{c}1") - F.col(f"{c}0") for c in AXES]
    return out.withColumn("orientation", geometry.axis_family(delta)).withColumn("name", tx.edge_id(F.col("junction0"), F.col("junction1")))


def clusters(edges: DataFrame, radii: Sequence[float], group: str = "main") -> dict[str, DataFrame]:
    """Of one group's edges: components that share junctions, and density clusters at each radius, with one row of metrics for each."""
    own = edges.filter(F.col("group") == group).select(F.col("source_strut_id").alias("id"), "junction0", "junction1", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"))
    shared = joins.shared_node_components(own, "id", "junction0", "junction1")
    out = {"shared": shared, "shared_metrics": graph.component_sizes(shared).crossJoin(joins.shared_node_pair_count(own, "id", "junction0", "junction1"))}
    for r in radii:
        out[f"radius_{r:g}"] = spatial.dbscan(own, "id", AXES, r)
        out[f"radius_{r:g}_metrics"] = spatial.cluster_metrics(own, "id", AXES, r)
    return out


def random_baseline(edges: DataFrame, replicates: int, strata: Sequence[str] = (), group: str = "main", seed: int = 9) -> DataFrame:
    """Adjacent pairs and clustered share of the group, against as many edges drawn from all that are not intentional (in each stratum, if named)."""
    pool = edges.filter(F.col("group") != "intentional").select(F.col("source_strut_id").alias("id"), "group", "junction0", "junction1", *strata)
    adjacent = joins.shared_node_pairs(pool, "id", "junction0", "junction1")
    wanted = pool.groupBy(*strata).agg(F.count_if(F.col("group") == group).alias("wanted"))
    reps = edges.sparkSession.range(-1, replicates).withColumnRenamed("id", "replicate")  # -1 is what was seen
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("id").cast("string")).cast("binary"))
    each = pool.crossJoin(F.broadcast(reps))
    each = each.join(wanted, list(strata)) if strata else each.crossJoin(F.broadcast(wanted))
    rank = F.row_number().over(Window.partitionBy("replicate", *strata).orderBy(F.when(F.col("replicate") < 0, (F.col("group") != group).cast("int")).otherwise(0), order, "id"))
    drawn = each.withColumn("__r", rank).filter(F.col("__r") <= F.col("wanted")).select("replicate", "id")
    a = drawn.withColumnRenamed("id", "a")
    b = drawn.withColumnRenamed("id", "b")
    linked = adjacent.join(a, "a").join(b, ["replicate", "b"]).select("replicate", "a", "b")
    pairs = linked.groupBy("replicate").agg(F.count(F.lit(1)).alias("pairs"))
    touched = linked.select("replicate", F.explode(F.array("a", "b")).alias("id")).groupBy("replicate").agg(F.count_distinct("id").alias("clustered"))
    size = drawn.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"))
    return size.join(pairs, "replicate", "left").join(touched, "replicate", "left").select("replicate", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.coalesce("clustered", F.lit(0)) / F.col("n")).alias("clustered_share"))


def baseline_summary(draws: DataFrame, metric: str) -> DataFrame:
    """The seen value beside the null's mean, interval, effect and p."""
    seen = draws.filter("replicate < 0").first()
    if seen is None:
        raise ValueError("no edge of the group")
    return statistics.null_summary(draws.filter("replicate >= 0"), metric, float(seen[metric])).withColumn("observed", F.lit(float(seen[metric])))


def neighbour_association(edges: DataFrame, k: int, classes: Sequence[str] = ("missing", "broken"), group: str = "main") -> DataFrame:
    """Which classes stand near which: shares among each source's k nearest edges, all edges being candidates."""
    n = edges.count()
    if k >= n:
        raise ValueError("k must be smaller than the number of edges")
    vectors = edges.select(F.col("source_strut_id").alias("id"), F.array(*[f"mid_{c}" for c in AXES]).alias("v"), F.when((F.col("group") == group) & F.col("class").isin(list(classes)), F.col("class")).alias("label"))
    near = joins.nearest(vectors.filter("label is not null"), vectors, "id", "v", k)
    return spatial.composition(near, vectors.select("id", "label"), "id", "label", k)


def boundary_distribution(edges: DataFrame, dimensions: Sequence[str] = ("region_1", "orientation", "build_index"), classes: Sequence[str] = ("missing", "broken", "thin")) -> DataFrame:
    """Enrichment of classes over boundary and orientation, with tests; intentional removals are left out."""
    return statistics.enrichment(ag.enrichment_counts(edges.filter(F.col("group") != "intentional"), list(dimensions), "class", list(classes)))


# --- damage -----------------------------------------------------------------------------------------------------------------------


def lattice_keys(junctions: DataFrame) -> DataFrame:
    """Junctions with doubled integer coordinates i, j, k from cell (cx, cy, cz) and local position (0, 0.5, 1)."""
    return junctions.select("id", *[(2 * F.col(f"c{c}") + F.rint(2 * F.get("indices", F.lit(n)))).cast("long").alias(a) for n, (c, a) in enumerate(zip(AXES, "ijk", strict=True))])


def missing_nodes(spark: SparkSession, keyed: DataFrame, cells: int) -> DataFrame:
    return geometry.octet_nodes(spark, cells).join(keyed.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_anti")


def missing_edges(spark: SparkSession, keyed: DataFrame, struts: DataFrame, cells: int) -> DataFrame:
    """Template edges that no strut has, with kind: anchor_missing if an end is gone too, else record_deleted."""
    ends = keyed.select("id", F.struct("i", "j", "k").alias("at"))
    there = struts.join(ends.withColumnRenamed("id", "junction0").withColumnRenamed("at", "p"), "junction0").join(ends.withColumnRenamed("id", "junction1").withColumnRenamed("at", "q"), "junction1")
    have = there.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    want = geometry.octet_edges(spark, cells).select(F.struct("i", "j", "k").alias("a"), F.struct(F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("k2").alias("k")).alias("b")).select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    gone = want.join(have, ["p", "q"], "left_anti")
    nodes = ends.select(F.col("at").alias("n")).distinct()
    p = nodes.select(F.col("n").alias("p"), F.lit(True).alias("has_p"))
    q = nodes.select(F.col("n").alias("q"), F.lit(True).alias("has_q"))
    both = gone.join(p, "p", "left").join(q, "q", "left")
    return both.select("p", "q", F.when(F.col("has_p") & F.col("has_q"), "record_deleted").otherwise("anchor_missing").alias("kind"))


def lattice_to_space(keyed: DataFrame, junctions: DataFrame):
    """The affine map from doubled coordinates to positions."""
    both = keyed.join(junctions.select("id", *AXES), "id")
    return registration.affine_fit(both, list("ijk"), list(AXES))


def removed_by_design(coverage: DataFrame, key: str, radius: str, drop: str, share: float = 0.05, least: float = 1e-4, threshold: float = 0.20, gap: float = 0.10, agree: float = 2 / 3) -> DataFrame:
    """Struts whose coverage drops at the widest admissible step in the sorted median drops; none if no step is wide enough.

    Admissible: the upper side holds between max(3, `least` of the rows) and `share` of them, and lies above `threshold`; on at least `agree` of the radii
    each of its struts must lie above the split."""
    per = coverage.groupBy(key).agg(F.percentile(F.col(drop).cast("double"), 0.5).alias("median"))
    n = per.count()
    low, high = max(3, least * n), share * n
    values = per.filter(F.col("median") >= threshold - gap).groupBy("median").agg(F.count(F.lit(1)).alias("n"))
    # only values near or above the threshold are ordered: at most a share of the rows can be on the upper side
    down = Window.orderBy(F.desc("median"))
    steps = values.select("median", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("above"), F.lead("median").over(down).alias("below")).filter(F.col("above") <= high + 1)
    steps = steps.withColumn("below", F.coalesce("below", F.lit(threshold - gap)))
    fit = steps.filter((F.col("above") >= low) & (F.col("above") <= high) & (F.col("median") >= threshold) & (F.col("median") - F.col("below") >= gap))
    best = fit.agg(F.max(F.struct((F.col("median") - F.col("below")).alias("gap"), F.col("median").alias("at"))).alias("b")).select(F.col("b.at").alias("split"))
    upper = per.crossJoin(F.broadcast(best)).filter(F.col("median") >= F.col("split"))
    votes = coverage.join(upper.select(key, "split"), key).groupBy(key).agg(F.avg((F.col(drop) >= F.col("split") - gap / 2).cast("double")).alias("agreement"))
    return votes.filter(F.col("agreement") >= agree - 1e-9)


def id_gaps(struts: DataFrame, last: int) -> DataFrame:
    return sequences.id_gaps(struts, "id", 0, last + 1)
