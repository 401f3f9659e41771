"""Lattice documents: JSON with junctions, struts and unit cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.joins import references_or_fail, unique_or_fail

DOCUMENT = (
    "junctions array<struct<id:bigint,position:array<double>,indices:array<double>>>, "
    "struts array<struct<id:bigint,junction0:bigint,junction1:bigint,endpoints:array<bigint>,thickness:double,unit_cell_edge_idx:int>>, "
    "unit_cells array<struct<id:bigint,struts:array<bigint>,indices:array<int>>>"
)


def parse_documents(texts: DataFrame, column: str = "value", strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """junctions (id, x, y, z, indices), struts (id, junction0, junction1, thickness, unit_cell_edge_idx), cells (id, strut) from whole documents.

    strict: repeated ids, positions without three finite numbers and references to absent junctions are errors."""
    doc = texts.select(F.from_json(column, DOCUMENT).alias("d"))
    j = doc.select(F.explode("d.junctions").alias("j")).select("j.id", F.col("j.position").alias("p"), "j.indices")
    bad = F.col("id").isNull() | (F.size("p") != 3) | F.exists("p", lambda x: x.isNull() | F.isnan(x))
    if strict and not j.filter(F.coalesce(bad, F.lit(True))).isEmpty():
        raise ValueError("a junction has no id or no position")
    junctions = j.select("id", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")], "indices")
    s = doc.select(F.explode("d.struts").alias("s")).select("s.*")
    struts = s.select("id", F.coalesce("junction0", F.get("endpoints", F.lit(0))).alias("junction0"), F.coalesce("junction1", F.get("endpoints", F.lit(1))).alias("junction1"), "thickness", "unit_cell_edge_idx")
    cells = doc.select(F.explode("d.unit_cells").alias("c")).select("c.id", "c.indices", F.explode_outer("c.struts").alias("strut"))
    if strict:
        unique_or_fail(junctions, "id")
        unique_or_fail(struts, "id")
        for end in ("junction0", "junction1"):
            references_or_fail(struts, end, junctions, "id")
        references_or_fail(cells, "strut", struts, "id")
    return junctions, struts, cells


def read_lattice(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_documents(spark.read.text(path, wholetext=True), strict=strict)


def salvage(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Junctions (id, x, y, z) and struts (id, junction0, junction1) of damaged documents: whole records are found by their shape."""
    number = r"\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*"
    point = r'\{[^{}]*"id"\s*:\s*(\d+)[^{}]*"position"\s*:\s*\[' + number + "," + number + "," + number + r"\]"
    strut = r'\{[^{}]*"id"\s*:\s*(\d+)[^{}]*"junction0"\s*:\s*(\d+)[^{}]*"junction1"\s*:\s*(\d+)'
    found = lambda pattern, n: F.explode(F.arrays_zip(*[F.regexp_extract_all(column, F.lit(pattern), F.lit(k)).alias(f"f{k}") for k in range(1, n + 1)]))
    p = texts.select(found(point, 4).alias("r")).select(F.col("r.f1").cast("long").alias("id"), *[F.col(f"r.f{k}").cast("double").alias(c) for k, c in zip((2, 3, 4), "xyz", strict=True)])
    s = texts.select(found(strut, 3).alias("r")).select(F.col("r.f1").cast("long").alias("id"), F.col("r.f2").cast("long").alias("junction0"), F.col("r.f3").cast("long").alias("junction1"))
    return p.dropDuplicates(["id"]), s.dropDuplicates(["id"])


def strut_geometry(struts: DataFrame, junctions: DataFrame) -> DataFrame:
    """Struts with both ends, middle and length."""
    a = junctions.select(F.col("id").alias("junction0"), *[F.col(c).alias(f"{c}0") for c in "xyz"])
    b = junctions.select(F.col("id").alias("junction1"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    out = struts.join(a, "junction0").join(b, "junction1")
    for c in "xyz":
        out = out.withColumn(f"mid_{c}", (F.col(f"{c}0") + F.col(f"{c}1")) / 2)
    return out.withColumn("length", F.sqrt(sum((F.pow(F.col(f"{c}1") - F.col(f"{c}0"), 2) for c in "xyz"), F.lit(0.0))))
