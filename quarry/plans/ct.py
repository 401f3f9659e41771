"""Questions to a CT volume and its lattice: segmentation, skeleton points, lattice comparison, bounded looks into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import aggregates as ag
from quarry.operators import joins, spatial, voxels
from quarry.sources import volumes


def segmented(chunks: DataFrame, least: int = 1) -> DataFrame:
    """(vol, z, y, x, component, size, threshold) of one volume's voxels over its Otsu threshold, in components of at least `least` voxels.

    chunks: without halo. The threshold comes from the histogram, which the tasks count first."""
    cut = ag.otsu(volumes.histogram(chunks).groupBy("value").agg(F.sum("n").alias("n")))
    inside = volumes.voxels(chunks).crossJoin(F.broadcast(cut)).filter(F.col("v") > F.col("threshold"))
    found = voxels.mask_components(inside.select("z", "y", "x"), least)
    return found.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(chunks.select("vol").limit(1))).select("vol", "z", "y", "x", "component", "size", "threshold")


def skeleton_points(cells: DataFrame, value: str = "v") -> DataFrame:
    """x, y, z of every finite voxel that is not zero."""
    v = F.col(value).cast("double")
    return cells.filter((v != 0) & ~F.isnan(v) & (F.abs(v) != float("inf"))).select("x", "y", "z")


def compared_lattices(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], position: float = 1e-6, thickness: float = 1e-9, weld: float = 1e-6, details: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(counts, details) of two lattices, each (junctions: id, x, y, z; struts: id, junction0, junction1, thickness).

    counts: kind, n; details: kind, id, at most `details` of each kind, the least ids first. Junctions and struts are met by id: left_only, right_only,
    moved (further than `position`), rewired (other ends, whatever their order), thickness. Welded nodes and edges of both sides are counted too."""
    (j1, s1), (j2, s2) = left, right
    nodes = j1.select("id", *[F.col(c).alias(f"{c}1") for c in "xyz"], F.lit(True).alias("in1")).join(j2.select("id", *[F.col(c).alias(f"{c}2") for c in "xyz"], F.lit(True).alias("in2")), "id", "full")
    far = F.sqrt(sum((F.pow(F.col(f"{c}1") - F.col(f"{c}2"), 2) for c in "xyz"), F.lit(0.0)))
    ends = lambda s, k: s.select("id", F.least("junction0", "junction1").alias(f"a{k}"), F.greatest("junction0", "junction1").alias(f"b{k}"), F.col("thickness").alias(f"t{k}"), F.lit(True).alias(f"in{k}"))
    struts = ends(s1, 1).join(ends(s2, 2), "id", "full")
    both = F.col("in1") & F.col("in2")
    gauge = F.coalesce(F.abs(F.col("t1") - F.col("t2")) > thickness, F.col("t1").isNull() != F.col("t2").isNull())

    def kinds(rows: DataFrame, what: str, changes: dict[str, Column]) -> DataFrame:
        named = [F.when(F.col("in2").isNull(), f"{what}_left_only").when(F.col("in1").isNull(), f"{what}_right_only"), *[F.when(both & c, f"{what}_{name}") for name, c in changes.items()]]
        return rows.select("id", F.explode(F.array_compact(F.array(*named))).alias("kind"))

    found = kinds(nodes, "junction", {"moved": far > position}).unionByName(kinds(struts, "strut", {"rewired": (F.col("a1") != F.col("a2")) | (F.col("b1") != F.col("b2")), "thickness": gauge}))
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    for side, (j, s) in (("left", left), ("right", right)):
        members = j.select("id").join(spatial.near_components(j, "id", ["x", "y", "z"], weld), "id", "left").select("id", F.coalesce("component", "id").alias("node"))
        edges = spatial.welded_edges(s, members, "junction0", "junction1")
        for what, rows in (("nodes", members.select("node").distinct()), ("edges", edges)):
            counts = counts.unionByName(rows.agg(F.lit(f"{side}_welded_{what}").alias("kind"), F.count(F.lit(1)).alias("n")))
    few = joins.limited(found, ["kind"], "id", details)
    return counts, few.select("kind", F.explode("first").alias("id"))


def document_value(documents: DataFrame, column: str, pointer: str = "", most: int = 20_000) -> DataFrame:
    """(value, length, cut) of what a JSON pointer selects in each document, held to `most` characters: the look is bounded, `length` tells the whole."""
    value = F.col(column) if not pointer else tx.json_pointer(F.col(column), pointer)
    return documents.select(F.substring(value, 1, most).alias("value"), F.length(value).alias("length"), (F.length(value) > most).alias("cut"))


def methodology(reports: DataFrame, column: str, section: str, headings: dict[str, tuple[str, int]], most: int = 12_000) -> DataFrame:
    """(section, markdown) of reports: one named section (headings: its title and level), or `full`; held to `most` characters like any look."""
    if section != "full" and section not in headings:
        raise ValueError(f"section must be one of {', '.join(sorted([*headings, 'full']))}")
    text = F.col(column) if section == "full" else tx.heading_section(F.col(column), *headings[section])
    return reports.select(F.lit(section).alias("section"), F.substring(text, 1, most).alias("markdown"))
