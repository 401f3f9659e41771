"""All registered queries on the driver's tables, each with the SQL that gives the same rows.

Floating results are rounded before they are compared, as sums may be taken in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import aggregates as ag
from quarry.operators import audit, geometry, graph, joins, matching, registration, rules, sequences, spatial, statistics
from quarry.operators.filters import BoundedFilter, between_always, bounded, domain_violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), places))
    return df


# --- filters, lookups, rules --------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 30 AND l_discount <= 0.05
ORDER BY l_orderkey, l_linenumber LIMIT 200""")
def bounded_filter_topk(spark, sf_dir):
    spec = BoundedFilter({"l_returnflag": ["A", "R"]}, {"l_quantity": (10, 30), "l_discount": (None, 0.05)})
    spec.check(["l_returnflag"], ["l_quantity", "l_discount"])
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    return bounded(rows, spec, ["l_orderkey", "l_linenumber"])[0]


@query("""SELECT count(*) AS total_matches FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 30 AND l_discount <= 0.05""")
def bounded_filter_total(spark, sf_dir):
    spec = BoundedFilter({"l_returnflag": ["A", "R"]}, {"l_quantity": (10, 30), "l_discount": (None, 0.05)})
    return bounded(read(spark, sf_dir, "lineitem"), spec, ["l_orderkey", "l_linenumber"])[1]


@query("SELECT event_id, event_type, value FROM events WHERE value BETWEEN 5 AND 20 AND NOT isnan(value)")
def between_filter_nulls(spark, sf_dir):
    return between_always(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), {"value": (5, 20)})


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").filter("o_orderkey = 77")


@query("""SELECT 'l_discount' AS "column", count(*) FILTER (WHERE l_discount IS NULL OR isnan(l_discount) OR isinf(l_discount) OR l_discount < 0 OR l_discount > 0.08) AS violations FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity) OR l_quantity < 1) FROM lineitem""")
def domain_check(spark, sf_dir):
    return domain_violations(read(spark, sf_dir, "lineitem"), {"l_discount": (0, 0.08), "l_quantity": (1, None)})


@query("""SELECT l_orderkey, l_linenumber,
 CASE WHEN l_quantity <= 0.25 * 50 THEN 'missing' WHEN l_quantity <= 0.85 * 50 AND l_discount >= 0.05 THEN 'broken' ELSE 'intact' END AS state,
 concat_ws('|', CASE WHEN l_quantity < 10 THEN 'few' END, CASE WHEN l_discount > 0.07 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS failed
FROM lineitem""")
def rule_ladder(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    state = rules.coarse_state(F.col("l_quantity") / 50, 3 * F.col("l_discount"))
    failed = rules.failed_checks({"few": F.col("l_quantity") < 10, "cheap": F.col("l_discount") > 0.07, "untaxed": F.col("l_tax") == 0})
    return rows.select("l_orderkey", "l_linenumber", state.alias("state"), failed.alias("failed"))


@query("""SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'now' WHEN contains(lower(o_orderpriority), 'high') THEN 'soon'
 WHEN contains(lower(o_orderpriority), '-') THEN 'later' ELSE NULL END AS class FROM orders""")
def substring_classes(spark, sf_dir):
    ladder = (("urgent", "now"), ("high", "soon"), ("-", "later"))
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.substring_ladder(F.col("o_orderpriority"), ladder, 1, strict=False).alias("class"))


@query("""SELECT d.doc_id, d.lang AS automatic, CASE WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 0 THEN 'poor' ELSE d.lang END AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_override(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    human = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
    out = joins.chained(docs, [(read(spark, sf_dir, "labels"), "doc_id")])
    return out.select("doc_id", F.col("lang").alias("automatic"), rules.remapped(human, {"toxic": "review", "low": "poor"}, F.col("lang")).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice / 100000 > 2 THEN 'high' ELSE 'low' END AS price_class,
 round(CASE WHEN o_orderstatus = 'F' THEN greatest((1 - least(o_totalprice / 500000, 1.0)) / 0.2, (o_custkey % 7) / 3.0) END, 9) AS score FROM orders""")
def anomaly_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    realised = F.when(F.col("o_orderstatus") == "F", F.least(F.col("o_totalprice") / 500000, F.lit(1.0)))
    return rows.select("o_orderkey", F.when(F.col("o_totalprice").isNotNull(), F.when(F.col("o_totalprice") / 100000 > 2, "high").otherwise("low")).alias("price_class"), F.round(rules.anomaly_score(realised, F.col("o_custkey") % 7), 9).alias("score"))


# --- aggregates ---------------------------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max,
 count(*) / sum(count(*)) OVER () AS fraction FROM events GROUP BY event_type""")
def group_compare(spark, sf_dir):
    return rounded(ag.group_compare(read(spark, sf_dir, "events"), "event_type", "value"), "mean")


@query("""SELECT v.value, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) v(value)
LEFT JOIN orders ON o_orderpriority = v.value GROUP BY v.value""")
def value_counts_domain(spark, sf_dir):
    return ag.value_counts(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS rate_returned,
 count(*) FILTER (WHERE l_quantity > 25) AS n_large, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 9) AS rate_large FROM lineitem""")
def conditional_rates(spark, sf_dir):
    out = ag.rates(read(spark, sf_dir, "lineitem"), {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 25})
    return rounded(out, "rate_returned", "rate_large", places=9)


_QUANTILES = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(100 * p):02d}" for p in ag.PERCENTILES)


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE l_extendedprice IS NULL) AS missing, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, {_QUANTILES} FROM lineitem""")
def profile_stats(spark, sf_dir):
    out = ag.profile(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(out, "mean", "std", *[c for c in out.columns if c[0] == "p" and c[1:].isdigit()], places=4)


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS med, count(*) AS peers FROM part GROUP BY p_brand),
d AS (SELECT p.p_partkey, p.p_brand, p.p_retailprice, med, peers FROM part p JOIN m USING (p_brand)),
a AS (SELECT p_brand, median(abs(p_retailprice - med)) AS mad FROM d GROUP BY p_brand)
SELECT p_partkey, p_brand, round((p_retailprice - med) / (1.4826 * mad), 6) AS z, coalesce(peers >= 3 AND (p_retailprice - med) / (1.4826 * mad) > 1.2, false) AS outlier
FROM d JOIN a USING (p_brand)""")
def robust_outliers(spark, sf_dir):
    out = ag.robust_outliers(read(spark, sf_dir, "part"), "p_brand", "p_retailprice", limit=1.2)
    return rounded(out.select("p_partkey", "p_brand", "z", "outlier"), "z")


@query("""WITH c AS (SELECT least(950.0, quantile_cont(p_retailprice, 0.1)) AS cutoff FROM part)
SELECT p_partkey, round(cutoff, 6) AS cutoff, p_retailprice <= cutoff AND p_retailprice < 950 AS thin FROM part, c""")
def lower_tail_cutoff(spark, sf_dir):
    out = ag.lower_tail(read(spark, sf_dir, "part"), "p_retailprice", 950.0)
    return rounded(out.select("p_partkey", "cutoff", "thin"), "cutoff")


@query("""SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_grain(spark, sf_dir):
    keyed = read(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return ag.duplicate_keys(keyed, "sha256")


@query("""SELECT user_id, votes, min(event_type) AS mode FROM (SELECT user_id, event_type, count(*) AS votes, max(count(*)) OVER (PARTITION BY user_id) AS best FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
WHERE votes = best GROUP BY user_id, votes""")
def majority_vote(spark, sf_dir):
    return ag.mode(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_exact(spark, sf_dir):
    return ag.histogram(read(spark, sf_dir, "lineitem"), "l_quantity")


@query("""SELECT b.bin, round(b.bin * 5000.0, 6) AS low, count(l_orderkey) AS n FROM (SELECT range AS bin FROM range(20)) b
LEFT JOIN (SELECT l_orderkey, least(floor(l_extendedprice / 5000), 19) AS k FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000) ON k = b.bin GROUP BY b.bin""")
def histogram_bins(spark, sf_dir):
    return rounded(ag.binned(read(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20), "low")


_OTSU = """WITH h AS (SELECT {band} l_quantity AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS w0, sum(n * value) OVER w AS s0, sum(n) OVER (PARTITION BY {part}) AS w, sum(n * value) OVER (PARTITION BY {part}) AS s FROM h
 WINDOW w AS (PARTITION BY {part} ORDER BY value ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 6) AS between_ FROM r WHERE w0 > 0 AND w > w0)
SELECT {out} min(value) AS threshold FROM (SELECT *, max(between_) OVER (PARTITION BY {part}) AS best FROM b) WHERE between_ = best GROUP BY ALL"""


@query(_OTSU.format(band="", part="1", out=""))
def otsu_threshold(spark, sf_dir):
    return ag.otsu(ag.histogram(read(spark, sf_dir, "lineitem"), "l_quantity"))


@query(_OTSU.format(band="l_linenumber AS band,", part="band", out="band,"))
def band_otsu(spark, sf_dir):
    return ag.otsu(ag.histogram(read(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "band"), "l_quantity", "band"), "band")


@query("""WITH h AS (SELECT l_linenumber AS band, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY band ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY band) AS t FROM h)
SELECT band, min(value) AS quantile FROM r WHERE c >= 0.99 * t GROUP BY band""")
def histogram_quantile(spark, sf_dir):
    levels = ag.histogram(read(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "band"), "l_quantity", "band")
    return ag.histogram_quantile(levels, 0.99, "band")


_OVERLAP = """SELECT {by} n_a, n_b, n_both, round(CASE WHEN n_a + n_b = 0 THEN 1.0 ELSE 2.0 * n_both / (n_a + n_b) END, 6) AS dice,
 round(CASE WHEN n_a + n_b = n_both THEN 1.0 ELSE n_both::DOUBLE / (n_a + n_b - n_both) END, 6) AS iou, round(CASE WHEN n_a = 0 THEN 1.0 ELSE n_both::DOUBLE / n_a END, 6) AS inside
FROM (SELECT {of} count(*) FILTER (WHERE l_quantity > 20) AS n_a, count(*) FILTER (WHERE l_discount < 0.05) AS n_b, count(*) FILTER (WHERE l_quantity > 20 AND l_discount < 0.05) AS n_both FROM lineitem GROUP BY ALL)"""


@query(_OVERLAP.format(by="", of=""))
def mask_overlap(spark, sf_dir):
    return rounded(ag.overlap(read(spark, sf_dir, "lineitem"), F.col("l_quantity") > 20, F.col("l_discount") < 0.05), "dice", "iou", "inside")


@query(_OVERLAP.format(by="slab,", of="l_orderkey // 1024 AS slab,"))
def slab_overlap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("slab", F.floor(F.col("l_orderkey") / 1024))
    return rounded(ag.overlap(rows, F.col("l_quantity") > 20, F.col("l_discount") < 0.05, "slab"), "dice", "iou", "inside")


@query("SELECT min(p_size) AS min_p_size, max(p_size) AS max_p_size, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part")
def bounding_box(spark, sf_dir):
    return ag.bounds(read(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query("""SELECT dimension, level, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM (
 SELECT 'l_returnflag' AS dimension, l_returnflag AS level, * FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, * FROM lineitem)
GROUP BY 1, 2""")
def stratified_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount")
    out = ag.stratified(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], {"n": F.count(F.lit(1)), "mean_quantity": F.avg("l_quantity"), "discounted": F.count_if(F.col("l_discount") > 0.05)})
    return rounded(out, "mean_quantity")


_ENRICH = """WITH u AS (SELECT 'l_linestatus' AS dimension, l_linestatus AS level, l_returnflag AS c FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_returnflag FROM lineitem),
t AS (SELECT dimension, level, count(*) AS level_total FROM u GROUP BY 1, 2),
k AS (SELECT t.*, x.class FROM t, (VALUES ('A'), ('N'), ('R')) x(class)),
g AS (SELECT k.dimension, k.level, k.class, level_total, count(u.c) AS in_level FROM k LEFT JOIN u ON u.dimension = k.dimension AND u.level = k.level AND u.c = k.class GROUP BY ALL),
f AS (SELECT *, sum(in_level) OVER (PARTITION BY dimension, class)::BIGINT AS class_total, sum(level_total) OVER (PARTITION BY dimension, class)::BIGINT AS total FROM g),
x AS (SELECT f.*, unnest(range(greatest(0, level_total + class_total - total), least(level_total, class_total) + 1)) AS v FROM f),
l AS (SELECT *, lgamma(class_total + 1) - lgamma(v + 1) - lgamma(class_total - v + 1) + lgamma(total - class_total + 1) - lgamma(level_total - v + 1) - lgamma(total - class_total - level_total + v + 1)
 - (lgamma(total + 1) - lgamma(level_total + 1) - lgamma(total - level_total + 1)) AS lp FROM x),
s AS (SELECT *, max(CASE WHEN v = in_level THEN lp END) OVER (PARTITION BY dimension, level, class) AS seen FROM l),
p AS (SELECT dimension, level, class, in_level, level_total, class_total, total, least(1.0, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)) AS p FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension, class ORDER BY p) AS rk, count(*) OVER (PARTITION BY dimension, class) AS m FROM p),
q AS (SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY dimension, class ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT dimension, level, class, in_level, round((in_level / level_total) / (class_total / total), 6) AS ratio, round(p, 6) AS p, round(q, 6) AS q FROM q"""


@query(_ENRICH)
def enrichment(spark, sf_dir):
    counts = ag.enrichment_counts(read(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string")), ["l_linestatus", "l_linenumber"], "l_returnflag", ["A", "N", "R"])
    return rounded(statistics.enrichment(counts).select("dimension", "level", "class", "in_level", "ratio", "p", "q"), "ratio", "p", "q")


# --- joins and sets -----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, n_name, r_name, round(least(greatest(o_totalprice / 100000, 0), 1), 9) AS clipped
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def chained_left_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = joins.chained(orders, [(read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "c_custkey"), (read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "n_nationkey"), (read(spark, sf_dir, "region"), "r_regionkey")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name", F.round(F.least(F.greatest(F.col("o_totalprice") / 100000, F.lit(0.0)), F.lit(1.0)), 9).alias("clipped"))


@query("""WITH a AS (SELECT c_nationkey AS key, round(avg(c_acctbal), 6) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS key, round(avg(s_acctbal), 6) AS v FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1)
SELECT key, a.v AS "left", b.v AS "right", CASE WHEN b.v IS NULL THEN 'left_only' WHEN a.v IS NULL THEN 'right_only' WHEN abs(a.v - b.v) <= 500 THEN 'equal' ELSE 'mismatch' END AS state FROM a FULL JOIN b USING (key)""")
def tolerance_compare(spark, sf_dir):
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    b = read(spark, sf_dir, "supplier").filter("s_nationkey % 5 <> 0").groupBy(F.col("s_nationkey").alias("key")).agg(F.round(F.avg("s_acctbal"), 6).alias("v"))
    return joins.compare_tables(a, b, "key", "v", 500)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT p_partkey AS k FROM part WHERE p_size < 30)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_union, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both,
 (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS a_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS b_only, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) = 0 AS disjoint, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) = 0 AS a_subset""")
def set_reconcile(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = read(spark, sf_dir, "part").filter("p_size < 30").select(F.col("p_partkey").alias("k"))
    return joins.set_sizes(a, b)


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 1000), t AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT count(*) AS n FROM p JOIN t USING (doc_id)), np AS (SELECT count(*) AS n FROM p), nt AS (SELECT count(*) AS n FROM t)
SELECT np.n AS n_predicted, nt.n AS n_truth, b.n AS n_both, round(b.n / np.n, 9) AS "precision", round(b.n / nt.n, 9) AS recall FROM b, np, nt""")
def set_precision_recall(spark, sf_dir):
    p = read(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id")
    t = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return rounded(joins.precision_recall(p, t), "precision", "recall", places=9)


@query("""SELECT key, count(*) FILTER (WHERE s = 0) AS n_left, count(*) FILTER (WHERE s = 1) AS n_right FROM (SELECT c_nationkey AS key, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier)
GROUP BY key HAVING count(*) FILTER (WHERE s = 0) <> count(*) FILTER (WHERE s = 1)""")
def tally_equality(spark, sf_dir):
    out = joins.tallies_differ(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), "key")
    return out.select("key", F.col("n_left").cast("long"), F.col("n_right").cast("long"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def anti_join(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    rich = read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT a.o AS o1, a.p AS p1, b.o AS o2, b.p AS p2 FROM e a JOIN e b ON a.o = b.o AND a.p < b.p
UNION ALL SELECT a.o, a.p, b.o, b.p FROM e a JOIN e b ON a.p = b.p AND a.o < b.o""")
def shared_node_pairs(spark, sf_dir):
    """Orders and parts of all lines: an order has few lines and a part few orders, however large the table is."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    e = e.select(F.struct("o", "p").alias("edge"), F.concat(F.lit("o"), "o").alias("u"), F.concat(F.lit("p"), "p").alias("v"))
    return joins.shared_node_pairs(e, "edge", "u", "v").select(F.col("a.o").alias("o1"), F.col("a.p").alias("p1"), F.col("b.o").alias("o2"), F.col("b.p").alias("p2"))


_POINTS = "(SELECT c_custkey AS id, c_acctbal / 10 AS x, (c_custkey % 97) * 10.0 AS y FROM customer)"
_CLUSTERS = f"""WITH RECURSIVE p AS {_POINTS}, e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= RADIUS),
n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), c(id, l) AS (SELECT u, u FROM n UNION SELECT n.v, c.l FROM c JOIN n ON n.u = c.id)"""


def _points(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 97 * 10.0).alias("y"))


@query((_CLUSTERS + " SELECT a, b, round(d, 6) AS distance FROM e").replace("RADIUS", "12"))
def radius_pairs(spark, sf_dir):
    return rounded(joins.radius_pairs(_points(spark, sf_dir), "id", ["x", "y"], 12.0), "distance")


@query((_CLUSTERS + " SELECT p.id, coalesce(min(c.l), -1) AS cluster FROM p LEFT JOIN c USING (id) GROUP BY p.id").replace("RADIUS", "6"))
def dbscan(spark, sf_dir):
    return spatial.dbscan(_points(spark, sf_dir), "id", ["x", "y"], 6.0)


@query((_CLUSTERS + ", m AS (SELECT p.id, coalesce(min(c.l), p.id) AS node FROM p LEFT JOIN c USING (id) GROUP BY p.id) SELECT node, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM m JOIN p USING (id) GROUP BY node").replace("RADIUS", "4"))
def weld(spark, sf_dir):
    return rounded(spatial.weld(_points(spark, sf_dir), "id", ["x", "y"], 4.0), "x", "y")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_suppkey + 100000000 AS s FROM lineitem), n AS (SELECT p AS u, s AS v FROM e UNION ALL SELECT s, p FROM e),
c(id, l) USING KEY (id) AS (SELECT DISTINCT u, u FROM n UNION SELECT n.v, min(c.l) FROM c JOIN n ON n.u = c.id JOIN recurring.c AS r ON r.id = n.v WHERE c.l < r.l GROUP BY n.v) SELECT id, l AS component FROM c""")
def connected_components(spark, sf_dir):
    """Parts and suppliers of all lines."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000000).alias("dst"))
    return graph.connected_components(e)


@query("""WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey + 100000000 AS s FROM lineitem), d AS (SELECT count(*) AS degree FROM e GROUP BY p UNION ALL SELECT count(*) FROM e GROUP BY s)
SELECT degree, count(*) AS vertices FROM d GROUP BY 1""")
def degree_distribution(spark, sf_dir):
    return graph.degree_distribution(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000000).alias("dst")))


_KNN = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE SOURCES), d AS (SELECT q.vec_id AS source, p.vec_id AS neighbour, round(list_distance(q.e, p.embedding::DOUBLE[]), 6) AS distance
 FROM q JOIN embeddings p ON p.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 5)"""


#: The sources of the whole search, and those of the whole composition.
_HUNDREDS, _LABELLED = "vec_id % 100 = 0", "label IS NOT NULL"


def _neighbours(spark, sf_dir, sources):
    e = read(spark, sf_dir, "embeddings")
    return joins.nearest(e.filter(sources), e, "vec_id", "embedding", 5)


@query(_KNN.replace("SOURCES", _HUNDREDS) + " SELECT source, neighbour, distance, rank FROM k")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, _HUNDREDS)


_COMPOSITION = """, l AS (SELECT source, s.label AS source_class, t.label AS target_class FROM k JOIN embeddings s ON s.vec_id = source JOIN embeddings t ON t.vec_id = neighbour),
n AS (SELECT source_class, count(DISTINCT source) AS sources FROM l GROUP BY 1)
SELECT source_class, target_class, sources, round(count(*) / (sources * 5), 6) AS mean_share, round(count(DISTINCT source) / sources, 6) AS any_share FROM l JOIN n USING (source_class) GROUP BY source_class, target_class, sources"""


@query(_KNN.replace("SOURCES", _LABELLED) + _COMPOSITION)
def knn_composition(spark, sf_dir):
    classes = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rounded(spatial.composition(_neighbours(spark, sf_dir, _LABELLED), classes, "vec_id", "label", 5), "mean_share", "any_share")


# --- sequences ----------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1
HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)""")
def rank_audit(spark, sf_dir):
    return sequences.rank_problems(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1)) AS o_orderkey FROM orders) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def id_gap(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return sequences.id_gaps_of(orders.filter("o_orderstatus <> 'P'"), orders, "o_orderkey")


_RUNS = """WITH e AS (SELECT user_id, value < 10 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 10 ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, hit, island, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, coalesce(max(CASE WHEN hit THEN n END), 0) AS longest FROM r GROUP BY 1"""


@query(_RUNS)
def longest_run(spark, sf_dir):
    return sequences.longest_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 10)


@query("SELECT user_id, count(*) FILTER (WHERE c) AS changes FROM (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) GROUP BY 1")
def transitions(spark, sf_dir):
    return sequences.transitions(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def anchors_topn(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")
    return sequences.top_n(rows, ["o_orderpriority", "o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("""SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents ORDER BY turn, lang, source LIMIT 100""")
def round_robin_sample(spark, sf_dir):
    return sequences.round_robin(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100)


@query("""WITH m AS (SELECT DISTINCT round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY l_partkey), g AS (SELECT v AS below, lead(v) OVER (ORDER BY v) AS above FROM m)
SELECT below, above, round(above - below, 4) AS gap FROM g WHERE above IS NOT NULL ORDER BY above - below DESC, below DESC LIMIT 1""")
def largest_gap_split(spark, sf_dir):
    means = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("m"))
    return rounded(sequences.largest_gap(means, "m", "l_partkey"), "gap", places=4)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_window(spark, sf_dir):
    return sequences.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, 50)[0]


@query("""SELECT o_orderstatus, count(*) AS total, list_sort(list(o_orderkey) FILTER (WHERE r <= 5)) AS first FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1""".replace("list_sort(list(o_orderkey) FILTER (WHERE r <= 5)) AS first", "array_to_string(list_sort(list(o_orderkey) FILTER (WHERE r <= 5)), '|') AS first"))
def limited_details(spark, sf_dir):
    out = joins.limited(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", 5)
    return out.select("o_orderstatus", "total", F.array_join("first", "|").alias("first"))


# --- statistics ---------------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), p AS (SELECT *, round(exp(-k::DOUBLE / 10), 9) AS p FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p) SELECT l_suppkey, p, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_adjust(spark, sf_dir):
    tests = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k")).withColumn("p", F.round(F.exp(-F.col("k") / 10), 9))
    return rounded(statistics.benjamini_hochberg(tests, "p").select("l_suppkey", "p", "q"), "q")


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT *, k / n AS s, 1.959963984540054 AS z FROM g)
SELECT source, n, k, round(greatest(0, (s + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS low,
 round(least(1, (s + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS high FROM w""")
def wilson(spark, sf_dir):
    g = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return rounded(g.select("source", "n", "k", low.alias("low"), high.alias("high")), "low", "high", places=9)


def _scored(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("score"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


_SCORED = "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS score, quality FROM documents JOIN labels USING (doc_id)), w AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won, count(*) AS known FROM s a JOIN s b ON a.quality = 1 AND b.quality = 0 AND a.score IS NOT NULL AND b.score IS NOT NULL)"


@query(_SCORED + " SELECT (SELECT count(*) FROM s WHERE quality = 1 AND score IS NOT NULL) AS n_pos, (SELECT count(*) FROM s WHERE quality = 0 AND score IS NOT NULL) AS n_neg, round(won / known, 9) AS auc FROM w")
def auc(spark, sf_dir):
    return rounded(statistics.auc(_scored(spark, sf_dir), "score", F.col("quality") == 1), "auc", places=9)


@query(_SCORED + ", n AS (SELECT count(*) FILTER (WHERE quality = 1) AS all_pos, count(*) FILTER (WHERE quality = 0) AS all_neg FROM s) SELECT all_pos, all_neg, round(won / (all_pos * all_neg), 9) AS lower, round((won + all_pos * all_neg - known) / (all_pos * all_neg), 9) AS upper FROM w, n")
def auc_bounds(spark, sf_dir):
    return rounded(statistics.auc_bounds(_scored(spark, sf_dir), "score", F.col("quality") == 1), "lower", "upper", places=9)


@query("""WITH s AS (SELECT doc_id // 2 AS pair, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS score, doc_id % 2 = 0 AS pos FROM documents), g AS (SELECT pair, max(CASE WHEN pos THEN score END) AS p, max(CASE WHEN NOT pos THEN score END) AS n, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM s GROUP BY 1 HAVING np = 1 AND nn = 1),
c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE p > n) AS wins, count(*) FILTER (WHERE p = n) AS ties, count(*) FILTER (WHERE p IS NULL OR n IS NULL) AS unknown FROM g)
SELECT *, round((wins + 0.5 * ties) / pairs, 9) AS lower, round((wins + 0.5 * ties + unknown) / pairs, 9) AS upper FROM c""")
def matched_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("score"), (F.col("doc_id") % 2 == 0).alias("pos"))
    return rounded(statistics.matched_pairs(rows, "pair", "score", F.col("pos")), "lower", "upper", places=9)


@query("""WITH g AS (SELECT l_linestatus, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 10) AS hits FROM lineitem GROUP BY 1, 2)
SELECT *, pos >= 10 AS powered, round(CASE WHEN pos > 0 THEN hits / pos END, 9) AS sensitivity, NOT pos >= 10 OR hits / pos >= 0.75 AS passed FROM g""")
def powered_gate(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("pos"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10)).alias("hits"))
    return rounded(statistics.powered_gate(g, "pos", "hits"), "sensitivity", places=9)


_NULL = """WITH r AS (SELECT range AS replicate FROM range(200)), d AS (SELECT replicate, n_nationkey % 5 AS k, c_acctbal, row_number() OVER (PARTITION BY replicate ORDER BY md5('9:' || replicate || ':' || c_custkey), c_custkey) AS rk FROM customer JOIN nation ON c_nationkey = n_nationkey, r QUALIFY rk <= 40),
m AS (SELECT replicate, avg(c_acctbal) AS m FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(m), 4) AS null_mean, round(stddev_pop(m), 4) AS null_std, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, round((5000 - avg(m)) / stddev_pop(m), 4) AS effect, round((1 + count(*) FILTER (WHERE m >= 5000)) / (count(*) + 1), 6) AS p FROM m"""


def _null(rows):
    draws = statistics.null_draws(rows, "c_custkey", 40, 200).join(rows, "c_custkey").groupBy("replicate").agg(F.avg("c_acctbal").alias("m"))
    return rounded(rounded(statistics.null_summary(draws, "m", 5000.0), "null_mean", "null_std", "low", "high", "effect", places=4), "p")


@query(_NULL)
def permutation_null(spark, sf_dir):
    return _null(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))


@query()
def assignment(spark, sf_dir):
    """Suppliers matched to two customers each by balance, within nations; no SQL: tests hold it against all permutations."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.lit(True).alias("pos"), F.col("s_acctbal").alias("x"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") + 1000000).alias("id"), F.lit(False).alias("pos"), F.col("c_acctbal").alias("x"))
    return matching.match_controls(s.unionByName(c), "nation", "id", "pos", ["x"])


# --- geometry and fits --------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part)
SELECT p_partkey, CASE WHEN s1 > s0 THEN least(floor(3 * (p_size - s0) / (s1 - s0)), 2) ELSE 0 END::INT AS size_third, CASE WHEN r1 > r0 THEN least(floor(3 * (p_retailprice - r0) / (r1 - r0)), 2) ELSE 0 END::INT AS price_third,
 CASE (least(p_size - s0, s1 - p_size) <= 5 + 1e-9)::INT + (least(p_retailprice - r0, r1 - p_retailprice) <= 5 + 1e-9)::INT WHEN 2 THEN 'edge' WHEN 1 THEN 'face' ELSE 'interior' END AS region FROM part, b""")
def tertiles_regions(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    box = ag.bounds(part, "p_size", "p_retailprice")
    at = part.crossJoin(F.broadcast(box))
    lo, hi = [F.col("min_p_size"), F.col("min_p_retailprice")], [F.col("max_p_size"), F.col("max_p_retailprice")]
    return at.select("p_partkey", geometry.third(F.col("p_size"), lo[0], hi[0]).alias("size_third"), geometry.third(F.col("p_retailprice"), lo[1], hi[1]).alias("price_third"), geometry.boundary_region([F.col("p_size"), F.col("p_retailprice")], lo, hi, 5.0).alias("region"))


_ORIENTATION = """WITH d AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25)::DOUBLE AS x, (l_discount * 100 - 5)::DOUBLE AS y, (l_tax * 100 - 4)::DOUBLE AS z FROM lineitem), u AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM d),
s AS (SELECT *, coalesce(CASE WHEN abs(x / n) > 1e-6 THEN sign(x) END, CASE WHEN abs(y / n) > 1e-6 THEN sign(y) END, CASE WHEN abs(z / n) > 1e-6 THEN sign(z) END, 1) AS g FROM u)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 0 THEN concat_ws(':', round_even(2 * x / n * g, 0)::INT, round_even(2 * y / n * g, 0)::INT, round_even(2 * z / n * g, 0)::INT) END AS orientation FROM s"""


def _orientations(rows):
    delta = [F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5, F.col("l_tax") * 100 - 4]
    return rows.select("l_orderkey", "l_linenumber", geometry.orientation_key(delta).alias("orientation"))


@query(_ORIENTATION)
def orientation_bins(spark, sf_dir):
    return _orientations(read(spark, sf_dir, "lineitem"))


_RASTER = """WITH l AS (SELECT p_partkey AS id, p_partkey % 23 AS x0, p_partkey % 17 AS y0, p_size % 29 AS x1, p_size % 13 AS y1 FROM part), t AS (SELECT *, unnest(range(0, 21)) AS t FROM l),
v AS (SELECT DISTINCT id, round_even(x0 + (x1 - x0) * t / 20, 0)::BIGINT AS x, round_even(y0 + (y1 - y0) * t / 20, 0)::BIGINT AS y FROM t) SELECT x, y, CASE WHEN min(id) = max(id) THEN min(id) ELSE -1 END AS owner FROM v GROUP BY 1, 2"""


def _raster(parts):
    line = geometry.raster_points([F.col("p_partkey") % 23, F.col("p_partkey") % 17], [F.col("p_size") % 29, F.col("p_size") % 13], F.lit(20))
    cells = parts.select(F.col("p_partkey").alias("id"), F.explode(line).alias("c")).select("id", "c.x", "c.y")
    return geometry.owners(cells, ["x", "y"], "id")


@query(_RASTER)
def raster_ownership(spark, sf_dir):
    return _raster(read(spark, sf_dir, "part"))


@query("""WITH n AS (SELECT i.range AS i, j.range AS j, k.range AS k FROM range(9) i, range(9) j, range(9) k WHERE (i.range + j.range + k.range) % 2 = 0), d AS (SELECT a.i, a.j, a.k, count(*) AS degree FROM n a JOIN n b ON (a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2 = 2 GROUP BY ALL)
SELECT CASE degree WHEN 3 THEN 'corner' WHEN 5 THEN 'edge' WHEN 8 THEN 'face' WHEN 12 THEN 'interior' ELSE 'irregular' END AS role, count(*) AS nodes FROM d GROUP BY 1""")
def lattice_template(spark, sf_dir):
    e = geometry.octet_edges(spark, 4)
    code = lambda s: F.col(f"i{s}") * 10000 + F.col(f"j{s}") * 100 + F.col(f"k{s}")
    deg = graph.degrees(e.select(code("").alias("src"), code("2").alias("dst")))
    return deg.groupBy(geometry.node_role(F.col("degree")).alias("role")).agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT c_custkey, round((0.5 * c_acctbal - 2 * c_nationkey + 3) / (1 + 0.001 * c_nationkey), 6) AS x, round((c_acctbal + c_nationkey) / (1 + 0.001 * c_nationkey), 6) AS y, round((c_nationkey - 7) / (1 + 0.001 * c_nationkey), 6) AS z FROM customer")
def homogeneous_transform(spark, sf_dir):
    m = [[0.5, -2, 0, 3], [1, 1, 0, 0], [0, 1, 0, -7], [0, 0.001, 0, 1]]
    x, y, z = geometry.transformed([F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.lit(0.0)], m)
    return rounded(read(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def affine_fit(spark, sf_dir):
    m = registration.affine_fit(read(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_extendedprice"])
    return spark.createDataFrame([(round(float(m[0, 0]), 6), round(float(m[0, 1]), 4))], "slope double, intercept double")


@query("SELECT 0.6 AS scale, 0.0 AS rms".replace("0.6", "0.6::DOUBLE").replace("0.0 AS", "0.0::DOUBLE AS"))
def similarity_fit(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 31).cast("double").alias("z"))
    p = p.withColumns({"u": -0.6 * F.col("y") + 4, "v": 0.6 * F.col("x") - 1, "w": 0.6 * F.col("z") + 2})
    fit = registration.similarity_fit(p, ["x", "y", "z"], ["u", "v", "w"])
    rms = registration.residuals(p, ["x", "y", "z"], ["u", "v", "w"], fit["matrix"]).first()["rms"]
    return spark.createDataFrame([(round(fit["scale"], 6), round(float(rms), 6))], "scale double, rms double")


# --- text, JSON, audits ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.json_pointer(F.col("props"), "/k").alias("k"))


@query("SELECT c_custkey, regexp_extract(c_name, '#(\\d+)$', 1)::BIGINT AS number, format('E_N{:06d}_N{:06d}', least(c_custkey, c_nationkey), greatest(c_custkey, c_nationkey)) AS edge FROM customer")
def regex_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", r"#(\d+)$", 1).cast("long").alias("number"), tx.edge_id(F.col("c_custkey"), F.col("c_nationkey")).alias("edge"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(tx.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, octet_length(encode(html)) AS bytes FROM pages")
def heading_section(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines, n_chars, length(coalesce(text, '')) = n_chars AS consistent FROM documents")
def text_profile(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(t, "\n")).cast("long").alias("lines"), "n_chars", (F.length(t) == F.col("n_chars")).alias("consistent"))


@query("SELECT 'doc/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.octet_length(t).cast("long").alias("size"), F.sha2(t.cast("binary"), 256).alias("sha256"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 50 AS k FROM customer), u AS (SELECT unnest([c_custkey % 40, k]) AS id FROM c) SELECT id::VARCHAR AS id, count(*) AS n FROM u WHERE id NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""")
def provenance_coverage(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").select(F.concat_ws("|", (F.col("c_custkey") % 40).cast("string"), (F.col("c_custkey") % 50).cast("string")).alias("ids"))
    return audit.coverage(ids, "ids", read(spark, sf_dir, "nation"), "n_nationkey")


@query("""SELECT 'orders unique' AS "check", CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 0.0::DOUBLE AS expected, b::DOUBLE AS actual FROM (SELECT count(*) AS b FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'lines refer', CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END, 0, b FROM (SELECT count(*) AS b FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'nations', CASE WHEN n = 25 THEN 'PASS' ELSE 'FAIL' END, 25, n FROM (SELECT count(*) AS n FROM nation)
UNION ALL SELECT 'discount', CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END, 0, b FROM (SELECT count(*) AS b FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08)
UNION ALL SELECT 'flags add up', 'PASS', count(*) FILTER (WHERE l_returnflag IN ('A', 'N', 'R')), count(*) FROM lineitem
UNION ALL SELECT 'absent', 'SKIP', NULL, NULL""")
def audit_checks(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return audit.report(
        audit.unique(orders, "orders unique", "o_orderkey"),
        audit.refers(lines, "lines refer", "l_orderkey", orders, "o_orderkey"),
        audit.row_count(read(spark, sf_dir, "nation"), "nations", 25),
        audit.in_domain(lines, "discount", "l_discount", 0, 0.08),
        audit.identity(lines, "flags add up", F.count_if(F.col("l_returnflag").isin("A", "N", "R")), F.count(F.lit(1))),
        audit.skipped(spark, "absent"),
    )


# --- further operators of the inventory -------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(stddev_pop(l_quantity), 9) AS population, round(stddev_samp(l_quantity), 9) AS sample FROM lineitem GROUP BY 1")
def std_variants(spark, sf_dir):
    v = ag.number("l_quantity")
    out = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.stddev_pop(v).alias("population"), F.stddev_samp(v).alias("sample"))
    return rounded(out, "population", "sample", places=9)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber % 2 = 1")
def stride_sample(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").filter("l_orderkey % 7 = 0 and l_linenumber % 2 = 1")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_quantity - 25), l_orderkey, l_linenumber, l_extendedprice) = 1")
def nearest_per_group(spark, sf_dir):
    order = [F.abs(F.col("l_quantity") - 25), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    return sequences.first_per_group(read(spark, sf_dir, "lineitem"), ["l_partkey"], order, ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("SELECT 'customer' AS layer, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_layers(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("layer"), F.col("c_nationkey").alias("nation"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("layer"))
    return a.unionByName(b).groupBy("layer", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'same' AS "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 0.0::DOUBLE AS expected, n::DOUBLE AS actual FROM (SELECT count(*) AS n FROM ((SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer) UNION ALL (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)))""")
def table_equality(spark, sf_dir):
    return audit.same_rows(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct(), "same")


@query("""SELECT c.name, c.claimed, a.counted, CASE WHEN a.counted IS NULL THEN 'SKIP' WHEN a.counted = c.claimed THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES ('nation', 25::BIGINT), ('region', 6), ('absent', 1)) c(name, claimed)
LEFT JOIN (SELECT 'nation' AS name, count(*) AS counted FROM nation UNION ALL SELECT 'region', count(*) FROM region) a USING (name)""")
def row_claims(spark, sf_dir):
    claims = spark.createDataFrame([("nation", 25), ("region", 6), ("absent", 1)], "name string, claimed long")
    counted = [read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("counted")).select(F.lit(t).alias("name"), "counted") for t in ("nation", "region")]
    return audit.row_claims(claims, counted[0].unionByName(counted[1]))


@query("""SELECT p_partkey, to_json({'id': p_partkey, 'name': p_name, 'evidence': {'orders': coalesce(n, 0), 'size': p_size}}) AS document FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def augmented_json(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    out = joins.chained(read(spark, sf_dir, "part"), [(n, "p_partkey")])
    evidence = F.struct(F.coalesce("n", F.lit(0)).alias("orders"), F.col("p_size").alias("size"))
    return out.select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), evidence.alias("evidence"))).alias("document"))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, (l_quantity = lo AND 1 + l_discount * 0 = lo) OR (l_quantity = hi AND 50 + l_discount * 0 = hi) AS skin FROM lineitem, b""")
def skin_planes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    at = rows.crossJoin(F.broadcast(ag.bounds(rows, "l_quantity")))
    lo, hi, q = F.col("min_l_quantity"), F.col("max_l_quantity"), F.col("l_quantity")
    return at.select("l_orderkey", "l_linenumber", geometry.on_skin(q, F.when(q < 25, 1.0).otherwise(50.0), lo, hi).alias("skin"))


@query("""WITH e AS (SELECT user_id, event_id, value > 12 AS f, (value > 12) <> lag(value > 12) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events)
SELECT user_id, count(*) FILTER (WHERE f) AS filled, min(event_id) FILTER (WHERE f) AS first, max(event_id) FILTER (WHERE f) AS last, count(*) FILTER (WHERE c) AS changes FROM e GROUP BY 1""")
def foreground_profile(spark, sf_dir):
    return ag.foreground(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 12)


@query("""WITH r AS (SELECT l_orderkey, l_quantity, (row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY l_orderkey % 100) AS pos, l_orderkey % 100 AS band FROM lineitem)
SELECT band, round(avg(CASE WHEN pos < 0.1 THEN l_quantity END), 6) AS first, round(avg(CASE WHEN pos >= 0.2 AND pos < 0.8 THEN l_quantity END), 6) AS middle, round(avg(CASE WHEN pos >= 0.9 THEN l_quantity END), 6) AS last FROM r GROUP BY 1""")
def profile_slices(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("band", F.col("l_orderkey") % 100)
    return rounded(sequences.profile_slices(rows, "band", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"], "l_quantity"), "first", "middle", "last")


@query("""WITH t AS (SELECT p_partkey % 7 + 0.0::DOUBLE AS ax, p_size + 0.0::DOUBLE AS ay, p_partkey % 3 + 0.0::DOUBLE AS az, p_size % 5 + 0.0::DOUBLE AS bx, p_partkey % 11 + 0.0::DOUBLE AS by_, p_size % 4 + 0.0::DOUBLE AS bz, p_partkey % 13 + 0.0::DOUBLE AS cx, p_size % 6 + 0.0::DOUBLE AS cy, p_partkey % 2 + 0.0::DOUBLE AS cz FROM part)
SELECT round(sum(ax * (by_ * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by_ * cx)) / 6, 4) AS volume, round(sum(0.5 * sqrt(((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2 + ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) ** 2)), 4) AS area, count(*) AS triangles FROM t""")
def enclosed_volume(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    values = {"ax": k % 7, "ay": z, "az": k % 3, "bx": z % 5, "by": k % 11, "bz": z % 4, "cx": k % 13, "cy": z % 6, "cz": k % 2}
    return rounded(geometry.enclosed_volume(read(spark, sf_dir, "part").select(*[v.cast("double").alias(n) for n, v in values.items()])), "volume", "area", places=4)


@query("SELECT round(covar_pop(l_quantity, l_extendedprice), 4) AS covariance, round(corr(l_quantity, l_extendedprice), 9) AS correlation FROM lineitem")
def covariance(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").agg(F.covar_pop("l_quantity", "l_extendedprice").alias("covariance"), F.corr("l_quantity", "l_extendedprice").alias("correlation"))
    return rounded(rounded(out, "covariance", places=4), "correlation", places=9)


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_shape(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.explode(tx.json_keys(F.col("props"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey, string_agg(s_suppkey::VARCHAR, '|' ORDER BY s_suppkey::VARCHAR) AS ids, count(*) AS n FROM supplier GROUP BY 1")
def pipe_joined_ids(spark, sf_dir):
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(tx.piped(F.collect_list("s_suppkey")).alias("ids"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 ELSE n_chars END AS size, md5(CASE WHEN doc_id % 10 = 4 THEN 'x' ELSE coalesce(text, '') END) AS sha256 FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT 'f' || doc_id AS path, n_chars AS size, md5(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 10 <> 2)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN c.path IS NULL THEN 'orphan' WHEN a.path IS NULL THEN 'missing' WHEN c.size <> a.size THEN 'size' WHEN c.sha256 <> a.sha256 THEN 'hash' ELSE 'ok' END AS state FROM c FULL JOIN a USING (path)) GROUP BY 1""")
def manifest_integrity(spark, sf_dir):
    d, m, t = read(spark, sf_dir, "documents"), F.col("doc_id") % 10, F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("f"), "doc_id").alias("path")
    claimed = d.filter(m != 1).select(path, F.when(m == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.md5(F.when(m == 4, "x").otherwise(t).cast("binary")).alias("sha256"))
    actual = d.filter(m != 2).select(path, F.col("n_chars").alias("size"), F.md5(t.cast("binary")).alias("sha256"))
    return audit.manifest(claimed, actual).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_returnflag, count(*) AS n_all, count(*) / sum(count(*)) OVER () AS sa FROM lineitem GROUP BY 1), q AS (SELECT l_returnflag, count(*) AS n_sample, count(*) / sum(count(*)) OVER () AS ss FROM lineitem WHERE l_quantity < 5 GROUP BY 1)
SELECT l_returnflag, n_all, round(sa, 9) AS share_all, coalesce(n_sample, 0) AS n_sample, round(coalesce(ss, 0), 9) AS share_sample, round(coalesce(ss, 0) / sa, 6) AS ratio FROM p LEFT JOIN q USING (l_returnflag)""")
def sampling_bias(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rounded(rounded(ag.sample_bias(rows, rows.filter("l_quantity < 5"), "l_returnflag"), "share_all", "share_sample", places=9), "ratio")


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), h AS (SELECT greatest(0, least(127, floor((l_extendedprice - lo) / ((hi - lo) / 128)))) AS value, count(*)::DOUBLE AS n FROM lineitem, e GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS w0, sum(n * value) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS s0, sum(n) OVER () AS w, sum(n * value) OVER () AS s FROM h), b AS (SELECT *, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 6) AS v FROM r WHERE w > w0)
SELECT round(lo + (min(value) + 1) * ((hi - lo) / 128), 6) AS threshold FROM b, e WHERE v = (SELECT max(v) FROM b) GROUP BY lo, hi""")
def clipped_otsu(spark, sf_dir):
    return rounded(ag.clipped_otsu(read(spark, sf_dir, "lineitem"), "l_extendedprice"), "threshold")


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, p_retailprice >= 1000 AS mask, CASE WHEN p_retailprice >= 1000 THEN p_retailprice ELSE 0 END AS masked, round((p_retailprice - lo) / (hi - lo), 9) AS normalised FROM part, b""")
def threshold_masks(spark, sf_dir):
    out = ag.normalised(ag.masked(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1000.0), "p_retailprice")
    return rounded(out.drop("p_retailprice"), "normalised", places=9)


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?:src|href)\s*=\s*["'']([^"''#]+)', 1))), '|') AS assets FROM pages""")
def asset_references(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(tx.asset_references(F.col("html")), "|").alias("assets"))


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b, round(sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (a.c_nationkey - b.c_nationkey) ** 2), 6) AS distance FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""")
def point_distances(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    a = c.select(F.col("c_custkey").alias("a"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    b = c.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    return a.join(b, "a").select("a", "b", F.round(joins.distance("a_", "b_", ["x", "y"]), 6).alias("distance"))


# --- the flagship -----------------------------------------------------------------------------------------------------------------

_FLAGSHIP = (_CLUSTERS + """, k AS (SELECT p.id, coalesce(min(c.l), -1) AS cluster FROM p LEFT JOIN c USING (id) GROUP BY p.id),
u AS (SELECT c_mktsegment AS segment, cluster <> -1 AS clustered FROM k JOIN customer ON c_custkey = id)
SELECT segment, count(*) AS n, count(*) FILTER (WHERE clustered) AS n_clustered, round(count(*) FILTER (WHERE clustered) / count(*), 9) AS share FROM u GROUP BY 1""").replace("RADIUS", "6")


@query(_FLAGSHIP)
def flagship(spark, sf_dir):
    """Points are clustered by distance, and classes compared by how much of them lies in clusters."""
    found = spatial.dbscan(_points(spark, sf_dir), "id", ["x", "y"], 6.0)
    of = found.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id")
    return of.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") != -1).alias("n_clustered"), F.round(F.avg((F.col("cluster") != -1).cast("double")), 9).alias("share"))


__all__ = ["QUERIES", "SQL", "flagship"]
