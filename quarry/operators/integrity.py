"""States of junctions against their peers, stop gates and fields of view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.aggregates import number, quantiles

# Limits of the junction states and their confidences.
PEERS, OUTLIER, LEAST_SCALE = 3, 2.5, 1e-6
# Limits of the alignment gate (share of stations with material, median and 90th percentile of the distance to it).
FOUND, MEDIAN, NINETIETH = 0.85, 2.0, 4.0


def junction_states(df: DataFrame, expected: str, supported: str, metrics: Sequence[str]) -> DataFrame:
    """Adds state, confidence, peers_compared: under-fused where branches lack support; else malformed where a metric is a high outlier among
    the junctions of the same degree (PEERS of them at least), by median and MAD, or the population deviation where MAD is nothing; else good.

    Peers are reduced to a row for each degree and joined back; no window holds a degree's junctions."""
    one = df.groupBy(expected).agg(F.count(F.lit(1)).alias("__peers"), *[x for m in metrics for x in (F.percentile(number(m), 0.5).alias(f"__med_{m}"), F.stddev_pop(number(m)).alias(f"__std_{m}"))])
    on = df.join(one, expected)
    two = on.groupBy(expected).agg(*[F.percentile(F.abs(number(m) - F.col(f"__med_{m}")), 0.5).alias(f"__mad_{m}") for m in metrics])
    out = on.join(two, expected)
    high: Column = F.lit(False)
    for m in metrics:
        scale = 1.4826 * F.col(f"__mad_{m}")
        scale = F.when(scale > LEAST_SCALE, scale).otherwise(F.greatest(F.col(f"__std_{m}"), F.lit(LEAST_SCALE)))
        high = high | F.coalesce((number(m) - F.col(f"__med_{m}")) / scale > OUTLIER, F.lit(False))
    compared = F.col("__peers") >= PEERS
    lacking = F.col(expected) - F.col(supported)
    state = F.when(lacking > 0, "junction_under_fused").when(compared & high, "junction_enlarged_or_malformed").otherwise("good")
    sure = F.when(lacking > 0, F.least(F.lit(0.95), 0.65 + 0.08 * lacking)).when(compared & high, 0.70).otherwise(F.when(compared, 0.75).otherwise(0.60))
    return out.select(*df.columns, state.alias("state"), sure.alias("confidence"), compared.alias("peers_compared"))


def alignment_gate(stations: DataFrame, distance: str) -> DataFrame:
    """One row: stations, share of them that found material (a finite distance), median and 90th percentile of those, and reliable."""
    d = F.when(F.abs(number(distance)) < float("inf"), number(distance))
    one = stations.agg(F.count(F.lit(1)).alias("stations"), F.coalesce(F.avg(d.isNotNull().cast("double")), F.lit(0.0)).alias("found"))
    one = one.crossJoin(F.broadcast(quantiles(stations, d, [0.5, 0.9]))).select("stations", "found", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"))
    return one.withColumn("reliable", F.coalesce((F.col("found") >= FOUND) & (F.col("median") <= MEDIAN) & (F.col("p90") <= NINETIETH), F.lit(False)))


def best_order(samples: DataFrame, order: str, intensity: str) -> DataFrame:
    """One row: the order of axes whose samples have the largest median intensity (the first by name of equals), with that median."""
    medians = samples.groupBy(order).agg(F.percentile(number(intensity), 0.5).alias("median"))
    best = medians.agg(F.max("median").alias("median"))
    return medians.join(F.broadcast(best), "median").agg(F.min(order).alias(order), F.max("median").alias("median"))


def corridor_in_field(start: Sequence[Column], stop: Sequence[Column], shape: Sequence[int], padding: float) -> Column:
    """Whether the box around a line, widened by `padding` and rounded outwards to whole voxels, lies in a volume of this shape."""
    out = F.lit(True)
    for a, b, n in zip(start, stop, shape, strict=True):
        out = out & (F.floor(F.least(a, b) - padding) >= 0) & (F.ceil(F.greatest(a, b) + padding) + 1 <= n)
    return out
