"""Grouped summaries, histograms, thresholds and overlaps. NaN counts as missing throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """As double, NaN as null: Spark's aggregates would carry NaN on."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


#: Slots that a range of values is cut into, once and then again within a slot, before values are ordered.
SLOTS = 512
#: Bytes of a table, as Spark estimates them, up to which one aggregation buffer may hold its values.
BUFFER_BYTES = 256 << 20


def fits(df: DataFrame) -> bool:
    """Whether a table is surely small enough for its values to be held in one buffer."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BUFFER_BYTES


def quantiles(df: DataFrame, column: str | Column, shares: Sequence[float], group: str | None = None) -> DataFrame:
    """One row (q), or one for each group (group, q): exact percentiles by linear interpolation, in the order of `shares`; null and NaN do not count.

    Unless the table is small (`fits`), no buffer holds all values: they are counted and cut into SLOTS slots by range, each slot that holds a wanted rank is cut into as many again,
    and only values of such slots are ordered. Every side of a join here has a row for each group and slot or wanted rank at most. Null is a group;
    one without values is left out."""
    if fits(df):
        q = F.percentile(number(column), [float(p) for p in shares])
        return df.groupBy(group).agg(q.alias("q")).filter("q is not null") if group is not None else df.agg(F.coalesce(q, F.array().cast("array<double>")).alias("q"))
    by = ["g"] if group is not None else []
    # a struct around the group, as null fields of structs are equal to one another
    own = [F.struct(F.col(group).alias("key")).alias("g")] if by else []
    meet = lambda a, b, *more: a.join(b if by else F.broadcast(b), [*by, *more]) if by or more else a.crossJoin(F.broadcast(b))
    levels = df.select(*own, number(column).alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k"))
    edges = levels.groupBy(*by).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(x).alias("rank"), (x - F.floor(x)).alias("part")) for i, x in enumerate(place)])
    asked = edges.filter("n > 0").select(*by, F.explode(wanted).alias("w")).select(*by, "w.*").withColumn("next", F.col("rank") + (F.col("part") > 0).cast("long"))
    ranks = asked.select(*by, F.explode(F.array("rank", "next")).alias("rank")).distinct()

    def cut(rows: DataFrame, name: str) -> DataFrame:
        at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLOTS)
        return rows.withColumn(name, F.when(F.col("hi") > F.col("lo"), F.least(F.coalesce(at, F.lit(0)), F.lit(SLOTS - 1))).otherwise(0).cast("int")).drop("lo", "hi")

    def before(rows: DataFrame, start: Column, parts: list[str], order: str) -> DataFrame:
        upto = Window.partitionBy(*by, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("base", start + F.coalesce(F.sum("k").over(upto), F.lit(0)))

    holds = (F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("k"))
    first = cut(meet(levels, edges.select(*by, "lo", "hi")), "one")
    sums = before(first.groupBy(*by, "one").agg(F.sum("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")), F.lit(0), [], "one")
    hit = meet(sums, ranks).filter(holds).select(*by, "one", "lo", "hi", "base", "rank")
    second = cut(meet(first, hit.select(*by, "one", "lo", "hi", F.col("base").alias("start")).distinct(), "one"), "two")
    sums = before(second.groupBy(*by, "one", "two").agg(F.sum("k").alias("k"), F.min("start").alias("start")), F.col("start"), ["one"], "two")
    hit = meet(sums, hit.select(*by, "one", "rank"), "one").filter(holds).select(*by, "one", "two", "base", "rank")
    few = meet(second.drop("start"), hit.select(*by, "one", "two", F.col("base").alias("start")).distinct(), "one", "two")
    found = meet(before(few, F.col("start"), ["one", "two"], "v"), hit.select(*by, "one", "two", "rank"), "one", "two").filter(holds).select(*by, "rank", "v")
    both = asked.join(found.withColumnRenamed("v", "below"), [*by, "rank"]).join(found.select(*by, F.col("rank").alias("next"), F.col("v").alias("above")), [*by, "next"])
    value = F.col("below") + (F.col("above") - F.col("below")) * F.col("part")
    out = both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda x: x["q"]).alias("q"))
    return out.select(F.col("g.key").alias(group), "q") if by else out


def group_compare(df: DataFrame, group: str, metric: str) -> DataFrame:
    """count, fraction, mean, exact median, min and max of each group; null is a group."""
    total = Window.partitionBy()
    v = number(metric)
    small = fits(df)
    grouped = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), *([F.percentile(v, 0.5).alias("median")] if small else []))
    if small:
        return grouped.select(group, "n", "mean", "median", "min", "max", (F.col("n") / F.sum("n").over(total)).alias("fraction"))
    middle = quantiles(df, metric, [0.5], group).select(F.col(group).alias("__g"), F.col("q")[0].alias("median"))
    joined = grouped.join(middle, F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.select(group, "n", "mean", "median", "min", "max", (F.col("n") / F.sum("n").over(total)).alias("fraction"))


def value_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts of a fixed domain, 0 for what does not occur; other values are left out."""
    names = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def rates(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: for each condition the rows it holds for, and its share."""
    out = [F.count(F.lit(1)).alias("n")]
    for name, c in conditions.items():
        out += [F.count_if(c).alias(f"n_{name}"), F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"rate_{name}")]
    return df.agg(*out)


PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def profile(df: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """One row: rows, missing values, range, mean, population deviation and exact percentiles by linear interpolation."""
    v = number(column)
    one = [F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    if fits(df):
        both = df.agg(*one, F.percentile(v, [float(p) for p in percentiles]).alias("q"))
    else:
        both = df.agg(*one).crossJoin(F.broadcast(quantiles(df, column, percentiles)))
    return both.select("n", "missing", "min", "max", "mean", "std", *[F.get("q", F.lit(k)).alias(f"p{round(100 * p):02d}") for k, p in enumerate(percentiles)])


def robust_outliers(df: DataFrame, group: str, column: str, peers: int = 3, limit: float = 2.5) -> DataFrame:
    """Rows with median, mad and z = (x - median) / (1.4826 MAD) of their group; where MAD is 0 the population deviation is used.

    outlier: z > limit among at least `peers` rows. Groups are aggregated and joined back, so no window holds a group."""
    v = number(column)
    one = df.groupBy(group).agg(F.percentile(v, 0.5).alias("median"), F.count(v).alias("peers"), F.stddev_pop(v).alias("__std"))
    on = df.join(one, group)
    two = on.groupBy(group).agg(F.percentile(F.abs(number(column) - F.col("median")), 0.5).alias("mad"))
    out = on.join(two, group)
    sigma = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).otherwise(F.col("__std"))
    out = out.withColumn("z", F.when(sigma > 1e-12, (number(column) - F.col("median")) / sigma))
    return out.withColumn("outlier", F.coalesce((F.col("peers") >= peers) & (F.col("z") > limit), F.lit(False))).drop("__std")


def lower_tail(df: DataFrame, column: str, design: float, share: float = 0.1) -> DataFrame:
    """Rows with the cutoff min(design, quantile) and whether they lie at or under it and under the design value."""
    cut = quantiles(df, column, [share]).select(F.least(F.lit(float(design)), F.get("q", F.lit(0))).alias("cutoff"))
    return df.crossJoin(F.broadcast(cut)).withColumn("thin", F.coalesce((number(column) <= F.col("cutoff")) & (number(column) < design), F.lit(False)))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mode(df: DataFrame, group: str, value: str, order: Column | None = None) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen in `order`, or without an order the least."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("votes"), *([F.min(order).alias("seen")] if order is not None else []))
    best = F.min(F.struct(-F.col("votes"), *(["seen"] if order is not None else []), F.col(value).alias("value")))
    return counts.groupBy(group).agg(best.alias("b"), F.max("votes").alias("votes")).select(group, "votes", F.col("b.value").alias("mode"))


# --- histograms: (value, n) tables --------------------------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, *band: str) -> DataFrame:
    return df.filter(number(column).isNotNull()).groupBy(*band, number(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def binned(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in bins of equal width, the last one closed; values outside are left out, empty bins are 0."""
    v = number(column)
    inside = df.filter((v >= low) & (v <= high))
    place = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * ((high - low) / bins)).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def otsu(levels: DataFrame, *band: str) -> DataFrame:
    """The threshold t that parts (value, n) into value <= t and value > t with the largest variance between; the least of equals.

    Works on a histogram, whose size is that of the value domain, not of the data."""
    upto = Window.partitionBy(*band).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*band)
    n, v = F.col("n").cast("double"), F.col("value")
    runs = levels.select(*band, "value", F.sum(n).over(upto).alias("w0"), F.sum(n * v).over(upto).alias("s0"), F.sum(n).over(whole).alias("w"), F.sum(n * v).over(whole).alias("s"))
    w0, w1 = F.col("w0"), F.col("w") - F.col("w0")
    between = F.when((w0 > 0) & (w1 > 0), w0 * w1 * F.pow(F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1, 2))
    scored = runs.withColumn("between", F.round(between, 6)).filter("between is not null")
    return scored.groupBy(*band).agg(F.max(F.struct("between", -v)).alias("b")).select(*band, (-F.col("b")["col2"]).alias("threshold"))


def histogram_quantile(levels: DataFrame, share: float, *band: str) -> DataFrame:
    """The least value up to which at least that share of the counts lies."""
    upto = Window.partitionBy(*band).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    runs = levels.select(*band, "value", F.sum("n").over(upto).alias("c"), F.sum("n").over(Window.partitionBy(*band)).alias("t"))
    return runs.filter(F.col("c") >= share * F.col("t")).groupBy(*band).agg(F.min("value").alias("quantile"))


# --- masks ------------------------------------------------------------------------------------------------------------------------


def overlap(df: DataFrame, a: Column, b: Column, *by) -> DataFrame:
    """Counts of two masks and their Dice, IoU and containment; two empty masks agree (1.0)."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"))
    na, nb, both = F.col("n_a"), F.col("n_b"), F.col("n_both")
    either = na + nb - both
    return counts.withColumn("dice", F.when(na + nb == 0, 1.0).otherwise(2 * both / (na + nb))).withColumn("iou", F.when(either == 0, 1.0).otherwise(both / either)).withColumn("inside", F.when(na == 0, 1.0).otherwise(both / na))


def bounds(df: DataFrame, *axes: str) -> DataFrame:
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)])


def unpivoted(df: DataFrame, dimensions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each row and dimension: dimension, level (text) and the kept columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions]))
    return df.select(pairs.alias("d"), *keep).select("d.*", *keep)


def stratified(df: DataFrame, dimensions: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Measures of every level of every dimension, in one pass."""
    keep = sorted({c for c in df.columns})
    long = unpivoted(df, dimensions, keep)
    return long.groupBy("dimension", "level").agg(*[m.alias(k) for k, m in measures.items()])


def enrichment_counts(df: DataFrame, dimensions: Sequence[str], label: str, classes: Sequence[str]) -> DataFrame:
    """dimension, level, class, in_level, level_total, class_total, total; also for classes that a level lacks."""
    sums = [F.count_if(F.col(label) == c).alias(f"__{k}") for k, c in enumerate(classes)]
    levels = unpivoted(df, dimensions, [label]).groupBy("dimension", "level").agg(F.count(F.lit(1)).alias("level_total"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"__{k}").alias("in_level")) for k, c in enumerate(classes)]))
    long = levels.select("dimension", "level", "level_total", each.alias("c")).select("dimension", "level", "level_total", "c.*")
    of_class = Window.partitionBy("dimension", "class")
    return long.withColumn("class_total", F.sum("in_level").over(of_class)).withColumn("total", F.sum("level_total").over(of_class))


def clipped_otsu(df: DataFrame, column: str, bins: int = 128, low: float = 0.01, high: float = 0.99, least: int = 16) -> DataFrame:
    """Otsu over equal bins between two percentiles, values outside held to the ends; the threshold is the upper edge of its bin. Null for fewer values."""
    v = number(column)
    ends = df.agg(F.count(v).alias("total")).crossJoin(F.broadcast(quantiles(df, column, [low, high]))).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "total")
    at = df.filter(v.isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / width)))
    levels = at.filter(F.col("hi") > F.col("lo")).groupBy(place.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = otsu(levels)
    edge = F.col("lo") + (F.col("threshold") + 1) * width
    return ends.join(F.broadcast(found)).select(F.when(F.col("total") >= least, edge).alias("threshold"))


def foreground(df: DataFrame, line: str, position: str, mask: Column) -> DataFrame:
    """Of each line of a volume: foreground cells, the first and last of them, and how often the mask changes along the line."""
    w = Window.partitionBy(line).orderBy(position)
    flag = F.coalesce(mask, F.lit(False))
    marked = df.select(line, position, flag.alias("f"), (flag != F.lag(flag).over(w)).alias("c"))
    return marked.groupBy(line).agg(F.count_if("f").alias("filled"), F.min(F.when(F.col("f"), F.col(position))).alias("first"), F.max(F.when(F.col("f"), F.col(position))).alias("last"), F.count_if("c").alias("changes"))


def sample_bias(population: DataFrame, sample: DataFrame, level: str) -> DataFrame:
    """Share of each level in a sample beside its share in the population, and their ratio."""
    total = Window.partitionBy()
    p = population.groupBy(level).agg(F.count(F.lit(1)).alias("n_all")).withColumn("share_all", F.col("n_all") / F.sum("n_all").over(total))
    q = sample.groupBy(level).agg(F.count(F.lit(1)).alias("n_sample")).withColumn("share_sample", F.col("n_sample") / F.sum("n_sample").over(total))
    out = p.join(q, level, "left").withColumn("n_sample", F.coalesce("n_sample", F.lit(0))).withColumn("share_sample", F.coalesce("share_sample", F.lit(0.0)))
    return out.withColumn("ratio", F.col("share_sample") / F.col("share_all"))


def masked(df: DataFrame, value: str, threshold: float, strict: bool = False, fill: float = 0.0) -> DataFrame:
    """mask and masked value of every cell: at or above the threshold (above it, if strict)."""
    hit = F.coalesce(number(value) > threshold if strict else number(value) >= threshold, F.lit(False))
    return df.withColumn("mask", hit).withColumn("masked", F.when(hit, number(value)).otherwise(F.lit(fill)))


def normalised(df: DataFrame, value: str) -> DataFrame:
    """The value on a scale from 0 to 1 over the whole table; 0 where nothing varies."""
    ends = df.agg(F.min(number(value)).alias("__lo"), F.max(number(value)).alias("__hi"))
    at = df.crossJoin(F.broadcast(ends))
    return at.withColumn("normalised", F.when(F.col("__hi") > F.col("__lo"), (number(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.when(number(value).isNotNull(), 0.0))).drop("__lo", "__hi")
