"""Graph operators on edge tables: components, degrees, shared-node pairs, density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import materialize


def _measure(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex that has an edge; component is the smallest id that can be reached.

    Alternating large-star and small-star contraction: the number of rounds grows with the logarithm of the size, no vertex's
    neighbours are gathered, and each round's edges are stored. Self-loops count as vertices; null ends are ignored.
    """
    raw = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u is not null and v is not null")
    raw = materialize(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = raw.filter("u <> v")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _measure(now)
        if after == before or not after[0]:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ends = raw.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def numbered(components: DataFrame, prefix: str = "G") -> DataFrame:
    """Components with labels such as G0001, numbered by their smallest id; only one row for each component is ordered."""
    from pyspark.sql import Window

    roots = components.select("component").distinct().withColumn("n", F.row_number().over(Window.orderBy("component")))
    return components.join(roots.select("component", F.format_string(prefix + "%04d", F.col("n")).alias("label")), "component")


def component_sizes(components: DataFrame, total: int | None = None) -> DataFrame:
    """One row: components, the largest one, vertices, and the largest's share."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    one = sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum("size"), F.lit(0)).alias("vertices"))
    of = F.lit(total) if total is not None else F.col("vertices")
    return one.withColumn("largest_share", F.when(of > 0, F.col("largest") / of).otherwise(0.0))


def degrees(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """Degree of each vertex in the simple graph: parallel edges and self-loops do not count."""
    simple = edges.filter(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()
    return simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    return degrees(edges, u, v).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))
