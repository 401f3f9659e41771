"""Runs, ranks and samples over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_runs(df: DataFrame, group: str, order: list[str], condition: Column) -> DataFrame:
    """Length of the longest run of rows for which the condition holds, of each group (0 if none)."""
    w = Window.partitionBy(group).orderBy(*order)
    hit = F.coalesce(condition, F.lit(False))
    marked = df.select(group, hit.alias("hit"), (F.row_number().over(w) - F.row_number().over(Window.partitionBy(group, hit).orderBy(*order))).alias("island"))
    runs = marked.groupBy(group, "hit", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("longest"))


def longest_run_of_array(flags: Column, value: bool = True) -> Column:
    """start (0-based) and length of the longest run of a value in a boolean array; the first of equals; start -1 if none."""
    zero = F.struct(*[F.lit(x).alias(k) for k, x in (("at", 0), ("run", 0), ("start", -1), ("length", 0))])

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x.eqNullSafe(F.lit(value)), acc["run"] + 1).otherwise(0)
        better = run > acc["length"]
        return F.struct((acc["at"] + 1).alias("at"), run.alias("run"), F.when(better, acc["at"] - run + 1).otherwise(acc["start"]).alias("start"), F.when(better, run).otherwise(acc["length"]).alias("length"))

    return F.aggregate(flags, zero, step, lambda acc: F.struct(acc["start"].alias("start"), acc["length"].alias("length")))


def rank_problems(df: DataFrame, group: str, rank: str) -> DataFrame:
    """Groups whose ranks are not 1..N once each: rows, distinct ranks, least and largest."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rank).alias("n_distinct"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    return g.filter("n <> n_distinct or low <> 1 or high <> n")


def id_gaps(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Ids of [low, high) that the table lacks."""
    return df.sparkSession.range(low, high).withColumnRenamed("id", key).join(df.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def id_gaps_of(df: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Ids from the smallest to the largest of `whole` that the table lacks; none if `whole` has no ids."""
    low, high = whole.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long"))).first()
    return id_gaps(df, key, 0, 0) if low is None else id_gaps(df, key, low, high + 1)


def transitions(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """How often a value differs from the one before it."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.lag(value).over(w)
    return df.select(group, (before.isNotNull() & (before != F.col(value))).alias("c")).groupBy(group).agg(F.count_if(F.col("c")).alias("changes"))


def top_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def hash_order(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def round_robin(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows taken in turn from all strata, each in hash order."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def largest_gap(df: DataFrame, value: str, key: str, partitions: Column | None = None) -> DataFrame:
    """Below, above and gap of the widest step between neighbouring distinct values; of equals the higher.

    Values are cut into ranges of their own first, so that no task orders the whole column."""
    v = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).distinct()
    edges = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    slot = partitions if partitions is not None else F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256), F.lit(255))).otherwise(0)
    cut = v.crossJoin(F.broadcast(edges)).select("v", slot.cast("int").alias("slot"))
    inside = cut.select("v", F.lead("v").over(Window.partitionBy("slot").orderBy("v")).alias("next"))
    ends = cut.groupBy("slot").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    across = ends.select(F.col("last").alias("v"), F.lead("first").over(Window.orderBy("slot")).alias("next"))
    gaps = inside.unionByName(across).filter("next is not null").select(F.col("v").alias("below"), F.col("next").alias("above"), (F.col("next") - F.col("v")).alias("gap"))
    return gaps.agg(F.max(F.struct("gap", "below", "above")).alias("g")).select("g.below", "g.above", "g.gap")


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int | None]:
    """A page and the next page's offset (null at the end)."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more, limit 1 or more")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    more = df.orderBy(*order).offset(offset + limit).limit(1).count() > 0
    return rows, offset + limit if more else None


def profile_slices(df: DataFrame, group: str, order: list[str], value: str, edge: float = 0.1, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Means of a profile's first and last `edge` and of its middle, by position among the group's rows."""
    w = Window.partitionBy(group).orderBy(*order)
    at = (F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(group))
    placed = df.select(group, value, at.alias("at"))
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    return placed.groupBy(group).agg(mean(F.col("at") < edge).alias("first"), mean((F.col("at") >= low) & (F.col("at") < high)).alias("middle"), mean(F.col("at") >= 1 - edge).alias("last"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in a total order, by aggregation: one row of a group leaves each task."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    best = df.groupBy(*group).agg(F.min(F.struct(*keys, *columns)).alias("m"))
    return best.select(*group, *[F.col(f"m.{c}").alias(c) for c in columns])
