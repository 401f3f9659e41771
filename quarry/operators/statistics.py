"""Tests, intervals and scores over small tables of counts, or as scale-free aggregations over large ones."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table [[a, b], [c, d]]: all tables with the same margins that are no likelier."""
    row, column, total = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - total), min(row, column)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    x = np.arange(low, high, dtype=float)
    # from one table to the next by the ratio of their chances
    step = np.log((column - x) * (row - x)) - np.log((x + 1) * (total - column - row + x + 1))
    chance = log(column, low) + log(total - column, row - low) - log(total, row) + np.concatenate(([0.0], np.cumsum(step)))
    return float(min(1.0, np.exp(chance[chance <= chance[a - low] + 1e-7]).sum()))


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if None in t or any(x != x for x in t) else fisher_two_sided(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype="float64")


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Adds q: the running minimum, from the largest p on, of p m / rank; null p stays out of m. Families are small tables of tests."""
    real = F.col(p).isNotNull() & ~F.isnan(p)
    # nulls and NaN form families of their own, so they count in none
    part = [*family, real]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(p))
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    ranked = df.withColumn("__rank", rank).withColumn("__raw", F.col(p) * m / F.col("__rank"))
    down = Window.partitionBy(*part).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.when(real, F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__rank", "__raw")


def enrichment(counts: DataFrame, least: int = 5) -> DataFrame:
    """Rates, ratio, Fisher p and BH q (families: dimension and class) from enrichment_counts."""
    a, level, cls, total = (F.col(c) for c in ("in_level", "level_total", "class_total", "total"))
    able = (cls >= least) & (level > 0) & (total > level)
    out = counts.withColumn("percentage", 100 * a / level).withColumn("overall", 100 * cls / total)
    out = out.withColumn("ratio", F.when(cls > 0, (a / level) / (cls / total)))
    out = out.withColumn("p", F.when(able, fisher(a, level - a, cls - a, total - level - (cls - a))))
    return benjamini_hochberg(out, "p", ("dimension", "class")).withColumn("inferential", able)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval; null for n = 0."""
    share = hits / n
    centre = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def _by_score(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """For each distinct score its positives and negatives, and the negatives below it. Scores are cut into ranges first, so ranks need no single ordered
    partition of all rows."""
    s = F.col(score).cast("double")
    levels = df.filter(s.isNotNull() & ~F.isnan(s) & positive.isNotNull()).groupBy(s.alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    edges = levels.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256), F.lit(255))).otherwise(0).cast("int")
    cut = levels.crossJoin(F.broadcast(edges)).withColumn("slot", slot)
    slots = cut.groupBy("slot").agg(F.sum("neg").alias("n"))
    base = slots.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("within", within).join(F.broadcast(base), "slot").select("s", "pos", "neg", (F.col("base") + F.col("within")).alias("below"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """n_pos, n_neg, auc: the share of (positive, negative) pairs that the positive wins, ties half; by ranks, not by pairs."""
    won = F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))
    one = _by_score(df, score, positive).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum(won).alias("won"))
    return one.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def auc_bounds(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """lower and upper: pairs with an unknown score count for neither, then for the positive."""
    known = auc(df, score, positive)
    s = F.col(score).cast("double")
    unknown = s.isNull() | F.isnan(s)
    all_of = df.filter(positive.isNotNull()).agg(F.count_if(positive).alias("all_pos"), F.count_if(~positive).alias("all_neg"), F.count_if(positive & unknown).alias("no_pos"), F.count_if(~positive & unknown).alias("no_neg"))
    both = known.crossJoin(F.broadcast(all_of))
    won, pairs = F.coalesce(F.col("auc"), F.lit(0.0)) * F.col("n_pos") * F.col("n_neg"), F.col("all_pos").cast("double") * F.col("all_neg")
    open_pairs = pairs - F.col("n_pos").cast("double") * F.col("n_neg")
    return both.select("all_pos", "all_neg", F.when(pairs > 0, won / pairs).alias("lower"), F.when(pairs > 0, (won + open_pairs) / pairs).alias("upper"))


def matched_pairs(df: DataFrame, pair: str, score: str, positive: Column) -> DataFrame:
    """Of pairs of one positive and one negative: wins, ties, unknown, and the bounds of the share of wins (ties half)."""
    sides = df.groupBy(pair).agg(F.max(F.when(positive, F.col(score))).alias("p"), F.max(F.when(~positive, F.col(score))).alias("n"), F.count_if(positive).alias("np"), F.count_if(~positive).alias("nn")).filter("np = 1 and nn = 1")
    p, n = F.col("p"), F.col("n")
    unknown = p.isNull() | n.isNull() | F.isnan(p.cast("double")) | F.isnan(n.cast("double"))
    one = sides.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~unknown & (p > n)).alias("wins"), F.count_if(~unknown & (p == n)).alias("ties"), F.count_if(unknown).alias("unknown"))
    sure = F.col("wins") + 0.5 * F.col("ties")
    return one.withColumn("lower", F.when(F.col("pairs") > 0, sure / F.col("pairs"))).withColumn("upper", F.when(F.col("pairs") > 0, (sure + F.col("unknown")) / F.col("pairs")))


def powered_gate(metrics: DataFrame, positives: str, hits: str, least: int = 10, sensitivity: float = 0.75) -> DataFrame:
    """passed: every stratum with enough positives reaches the sensitivity, unknown decisions counting as misses."""
    return metrics.withColumn("powered", F.col(positives) >= least).withColumn("sensitivity", F.when(F.col(positives) > 0, F.col(hits) / F.col(positives))).withColumn("passed", ~F.col("powered") | (F.col("sensitivity") >= sensitivity))


def null_draws(df: DataFrame, key: str, n_drawn: int, replicates: int, strata: Sequence[str] = (), seed: int = 9) -> DataFrame:
    """(replicate, key): for each replicate the n_drawn rows (of each stratum, if named) that come first in hash order."""
    reps = df.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")).cast("binary"))
    each = df.select(key, *strata).crossJoin(F.broadcast(reps))
    w = Window.partitionBy("replicate", *strata).orderBy(order, key)
    return each.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n_drawn).select("replicate", key, *strata)


def powered_gates(controls: DataFrame, dimensions: Mapping[str, Column], success: Column, least: int = 10, sensitivity: float = 0.75) -> DataFrame:
    """(dimension, stratum, positives, successes, sensitivity, powered, passed) of positive controls; a null success counts as a miss.

    All dimensions are counted in one pass: a row is copied to each of them before it is grouped."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("stratum")) for name, c in dimensions.items()]))
    counts = controls.select(rows.alias("d"), F.coalesce(success, F.lit(False)).alias("s")).groupBy("d.dimension", "d.stratum").agg(F.count(F.lit(1)).alias("positives"), F.count_if("s").alias("successes"))
    out = counts.withColumn("sensitivity", F.col("successes") / F.col("positives")).withColumn("powered", F.col("positives") >= least)
    return out.withColumn("passed", ~F.col("powered") | (F.col("sensitivity") >= sensitivity))


def association_tests(tests: DataFrame, p_columns: Sequence[str], model: str) -> DataFrame:
    """Adds q_<p> for each column of p values: each model and direction is a family of its own."""
    for p in p_columns:
        tests = benjamini_hochberg(tests, p, (model,)).withColumnRenamed("q", f"q_{p}")
    return tests


def uniform_points(spark, n: int, bounds: Sequence[tuple[float, float]], replicates: int, seed: int = 9) -> DataFrame:
    """(replicate, id, c0, c1, ...): n points for each replicate, spread over a box by digests of seed, replicate, number and axis."""
    rows = spark.range(n * replicates).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("id"))
    text = lambda axis: F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("id").cast("string"), F.lit(str(axis)))
    share = lambda axis: F.conv(F.substring(F.md5(text(axis).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return rows.select("replicate", "id", *[(lo + (hi - lo) * share(k)).alias(f"c{k}") for k, (lo, hi) in enumerate(bounds)])


def uniform_null(spark, n: int, bounds: Sequence[tuple[float, float]], radius: float, replicates: int, seed: int = 9) -> DataFrame:
    """(replicate, pairs, clustered_share) of points spread evenly over a box: pairs within the radius, and the share of points in any."""
    from quarry.operators.joins import radius_pairs

    points = uniform_points(spark, n, bounds, replicates, seed)
    # replicates lie apart on an axis of their own, so one search serves all of them
    apart = points.withColumn("apart", F.col("replicate") * (4.0 * radius)).withColumn("point", F.col("replicate") * n + F.col("id"))
    found = radius_pairs(apart, "point", [*[f"c{k}" for k in range(len(bounds))], "apart"], radius)
    counts = found.groupBy(F.floor(F.col("a") / n).alias("replicate")).agg(F.count(F.lit(1)).alias("pairs"))
    touched = found.select(F.explode(F.array("a", "b")).alias("p")).distinct().groupBy(F.floor(F.col("p") / n).alias("replicate")).agg(F.count(F.lit(1)).alias("touched"))
    every = spark.range(replicates).withColumnRenamed("id", "replicate").join(counts, "replicate", "left").join(touched, "replicate", "left")
    return every.select("replicate", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.coalesce("touched", F.lit(0)) / F.lit(n)).alias("clustered_share"))


def null_summary(draws: DataFrame, metric: str, observed: float, lower_is_clustered: bool = False) -> DataFrame:
    """null mean, deviation, 95 % interval, effect (null where nothing varies) and p = (1 + hits) / (n + 1); draws that are not finite are dropped."""
    v = F.col(metric).cast("double")
    real = draws.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    hit = F.count_if(v <= observed) if lower_is_clustered else F.count_if(v >= observed)
    one = real.agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("null_mean"), F.stddev_pop(v).alias("null_std"), F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high"), hit.alias("hits"))
    return one.select("n", "null_mean", "null_std", "low", "high", F.when(F.col("null_std") > 0, (F.lit(observed) - F.col("null_mean")) / F.col("null_std")).alias("effect"), ((1 + F.col("hits")) / (F.col("n") + 1)).alias("p"))
