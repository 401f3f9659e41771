"""Joins with checked cardinality, and set reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_or_fail(df: DataFrame, *keys: str) -> DataFrame:
    """The table; ValueError if a key occurs twice (one aggregation, nothing is collected but a flag)."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)}: not unique")
    return df


def references_or_fail(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    loose = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    if not loose.isEmpty():
        raise ValueError(f"{column}: values that {key} lacks")
    return df


def chained(left: DataFrame, sides: Sequence[tuple[DataFrame, str]], check: bool = True) -> DataFrame:
    """One-to-one left joins, one after another; the rows of `left` neither multiply nor go."""
    for side, key in sides:
        left = left.join(unique_or_fail(side, key) if check else side, key, "left")
    return left


def conflicting_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.groupBy(key).agg(F.count_distinct(label).alias("labels")).filter("labels > 1")


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, left, right, state (left_only, right_only, mismatch, equal) by a full outer join; null equals null."""
    x = a.select(F.col(key).alias("key"), F.col(value).cast("double").alias("left"), F.lit(True).alias("in_left"))
    y = b.select(F.col(key).alias("key"), F.col(value).cast("double").alias("right"), F.lit(True).alias("in_right"))
    near = (F.col("left").isNull() & F.col("right").isNull()) | F.coalesce(F.abs(F.col("left") - F.col("right")) <= tolerance, F.lit(False))
    state = F.when(F.col("in_right").isNull(), "left_only").when(F.col("in_left").isNull(), "right_only").when(near, "equal").otherwise("mismatch")
    return x.join(y, "key", "full").select("key", "left", "right", state.alias("state"))


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row about the distinct rows of two tables with the same columns: sizes of both, union, intersection and differences."""
    tagged = a.distinct().withColumn("__a", F.lit(1)).unionByName(b.distinct().withColumn("__a", F.lit(0)))
    keys = [c for c in a.columns]
    sides = tagged.groupBy(*keys).agg(F.max("__a").alias("in_a"), F.min("__a").alias("no_b"))
    a_only, b_only = (F.col("no_b") == 1), (F.col("in_a") == 0)
    return sides.agg(
        F.count_if(~b_only).alias("n_a"), F.count_if(~a_only).alias("n_b"), F.count(F.lit(1)).alias("n_union"), F.count_if(~a_only & ~b_only).alias("n_both"), F.count_if(a_only).alias("a_only"), F.count_if(b_only).alias("b_only")
    ).withColumn("disjoint", F.col("n_both") == 0).withColumn("a_subset", F.col("a_only") == 0)


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of one set against another; 1.0 where there is nothing to find."""
    s = set_sizes(predicted, truth)
    return s.select(
        F.col("n_a").alias("n_predicted"),
        F.col("n_b").alias("n_truth"),
        "n_both",
        F.when(F.col("n_a") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_a")).alias("precision"),
        F.when(F.col("n_b") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_b")).alias("recall"),
    )


def tallies_differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur a different number of times in the two tables."""
    both = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(key).agg(F.sum("x").alias("n_left"), F.sum("y").alias("n_right")).filter("n_left <> n_right")


def limited(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """The n least values of each group beside the count of all. Each task keeps n rows of a group before they are shuffled."""
    from pyspark.sql import Window

    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(value))).filter(F.col("__r") <= n)
    few = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias("first"))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total")).join(few, group, "left")


def shared_node_pairs(edges: DataFrame, edge: str, u: str, v: str) -> DataFrame:
    """Pairs (a < b) of edges that share an end, once each."""
    ends = edges.select(F.col(edge).alias("edge"), F.explode(F.array_distinct(F.array(F.col(u), F.col(v)))).alias("node"))
    other = ends.select(F.col("edge").alias("other"), "node")
    return ends.join(other, "node").filter(F.col("edge") < F.col("other")).select(F.col("edge").alias("a"), F.col("other").alias("b")).distinct()


def shared_node_components(edges: DataFrame, edge: str, u: str, v: str) -> DataFrame:
    """(edge, component) of edges that shared ends connect, component being the smallest edge; by links of edges with nodes, so a node with very many
    edges costs one link for each and no pairs. Edges and nodes are whole numbers."""
    from quarry.operators.graph import connected_components

    ends = edges.select((2 * F.col(edge)).alias("e"), F.explode(F.array(F.col(u), F.col(v))).alias("n"))
    found = connected_components(ends.select("e", (2 * F.col("n") + 1).alias("n")), "e", "n")
    own = found.filter(F.col("id") % 2 == 0).select((F.col("id") / 2).cast("long").alias(edge), F.col("component").alias("c"))
    least = own.groupBy("c").agg(F.min(edge).alias("component"))
    return own.join(least, "c").select(edge, "component")


def shared_node_pair_count(edges: DataFrame, edge: str, u: str, v: str) -> DataFrame:
    """One row: how many pairs of edges share an end, without listing them: over nodes, less those counted at both ends."""
    ends = edges.select(F.col(edge), F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    two = lambda n: n * (n - 1) / 2
    at = ends.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(two(F.col("k"))), F.lit(0)).alias("once"))
    both = ends.filter("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(two(F.col("k"))), F.lit(0)).alias("twice"))
    return at.crossJoin(both).select((F.col("once") - F.col("twice")).cast("long").alias("pairs"))


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both tables side by side, by an explicit key that each has once; a key of one table alone is an error."""
    left, right = a.withColumn("__l", F.lit(True)), b.withColumn("__r", F.lit(True))
    both = left.join(right, key, "full")
    alone = F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean")
    return both.filter(F.when(F.col("__l").isNull() | F.col("__r").isNull(), alone).otherwise(True)).drop("__l", "__r")


def distance(a: str, b: str, axes: Sequence[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in axes), F.lit(0.0)))


def radius_pairs(points: DataFrame, key: str, axes: Sequence[str], radius: float) -> DataFrame:
    """Pairs (a < b) of points at most `radius` apart, with their distance.

    Points meet in grid cells as wide as the radius: one side is copied to the cells around it, so no theta join is made. A point with a
    null or NaN coordinate has no neighbours."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    real = points.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in axes])
    for c in axes:
        real = real.filter(F.col(c).isNotNull() & ~F.isnan(c))
    cells = [F.floor(F.col(c) / radius) for c in axes]
    left = real.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in axes], *[cell.alias(f"cell_{c}") for c, cell in zip(axes, cells, strict=True)])
    right = real.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in axes], *[cell.alias(f"cell_{c}") for c, cell in zip(axes, cells, strict=True)])
    for c in axes:
        steps = F.explode(F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)]))
        right = right.withColumn("__s", steps).withColumn(f"cell_{c}", F.col(f"cell_{c}") + F.col("__s")).drop("__s")
    joined = left.join(right, [f"cell_{c}" for c in axes]).filter("a < b")
    return joined.withColumn("distance", distance("a_", "b_", axes)).filter(F.col("distance") <= radius).select("a", "b", "distance")


def nearest(sources: DataFrame, pool: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest of the pool for each source (source, neighbour, distance, rank): Euclidean, itself left out, ties by key.

    Sources come in blocks that a task holds beside each batch of the pool: every task keeps k of its own for each source, so what is
    shuffled is tasks x sources x k rows. The block is broadcast only up to MOST_SOURCES rows; more sources take further blocks."""
    from quarry.operators.knn import blocked_nearest

    return blocked_nearest(sources, pool, key, vector, k)
