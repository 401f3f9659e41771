"""Queries on junctions, struts, evidence and their files, over the driver's tables: customers are junctions, orders struts between them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import aggregates as ag
from quarry.operators import audit, filters, geometry, graph, integrity, joins, rules, sequences, spatial, statistics, voxels
from quarry.plans import inspection
from quarry.plans.catalogue import _CLUSTERS, _points, query, read, rounded
from quarry.sources import lattice, tables, volumes
from quarry.sources.shared import shared_dir

# --- filters and rules ------------------------------------------------------------------------------------------------------------

_SPECS = {
    "good": ({"l_returnflag": ["A"]}, {"l_quantity": (1, 5)}, 200),
    "open range": ({}, {"l_quantity": (None, 5)}, 1),
    "inverted": ({}, {"l_quantity": (5, 1)}, 200),
    "unknown column": ({"l_comment": ["x"]}, {}, 200),
    "repeated value": ({"l_returnflag": ["A", "A"]}, {}, 200),
    "outside the domain": ({"l_returnflag": ["X"]}, {}, 200),
    "limit": ({}, {}, 501),
}


@query("""SELECT * FROM (VALUES ('good', true, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity BETWEEN 1 AND 5)), ('open range', true, (SELECT count(*) FROM lineitem WHERE l_quantity <= 5)),
 ('inverted', false, NULL), ('unknown column', false, NULL), ('repeated value', false, NULL), ('outside the domain', false, NULL), ('limit', false, NULL)) v(spec, accepted, matches)""")
def range_validation(spark, sf_dir):
    """Specifications are refused before anything runs; those that hold give their number of matches."""
    rows, out = read(spark, sf_dir, "lineitem"), None
    for name, (values, ranges, limit) in _SPECS.items():
        spec = filters.BoundedFilter(values, ranges, limit)
        try:
            spec.check(["l_returnflag"], ["l_quantity"], {"l_returnflag": ["A", "N", "R"]})
            one = filters.bounded(rows, spec, ["l_orderkey", "l_linenumber"])[1].select(F.lit(name).alias("spec"), F.lit(True).alias("accepted"), F.col("total_matches").alias("matches"))
        except ValueError:
            one = spark.range(1).select(F.lit(name).alias("spec"), F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("matches"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS mean, quantile_cont(l_tax, 0.5) AS median, min(l_tax) AS min, max(l_tax) AS max, count(*) / sum(count(*)) OVER () AS fraction FROM lineitem GROUP BY 1""")
def allowed_comparison(spark, sf_dir):
    """Group and metric come from lists of what may be asked for."""
    found = inspection.Artifacts(read(spark, sf_dir, "lineitem"), "l_orderkey", groups=("l_returnflag", "l_linestatus"), metrics=("l_tax", "l_discount"))
    return rounded(found.compare("l_returnflag", "l_tax"), "mean")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def public_columns(spark, sf_dir):
    """Only listed columns leave, in the list's order; those that a table lacks are passed over."""
    return filters.public_columns(read(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_phone"])


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'main' WHEN 'signup' THEN 'present' END AS category FROM events")
def nullable_category(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", rules.remapped(F.col("event_type"), {"error": "main", "signup": "present"}, F.lit(None).cast("string")).alias("category"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 50) + 0.25 AS ax, (p_size % 40) + 0.5 AS ay, (p_partkey % 30) + 0.0 AS az, (p_size % 45) + 0.75 AS bx, (p_partkey % 35) + 0.5 AS by_, (p_size % 25) + 3.0 AS bz FROM part)
SELECT p_partkey, floor(least(ax, bx) - 3.5) >= 0 AND ceil(greatest(ax, bx) + 3.5) + 1 <= 48 AND floor(least(ay, by_) - 3.5) >= 0 AND ceil(greatest(ay, by_) + 3.5) + 1 <= 40 AND floor(least(az, bz) - 3.5) >= 0 AND ceil(greatest(az, bz) + 3.5) + 1 <= 32 AS eligible FROM p""")
def corridor_in_field(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    start, stop = [k % 50 + 0.25, z % 40 + 0.5, k % 30 + 0.0], [z % 45 + 0.75, k % 35 + 0.5, z % 25 + 3.0]
    return read(spark, sf_dir, "part").select("p_partkey", integrity.corridor_in_field(start, stop, (48, 40, 32), 3.5).alias("eligible"))


@query("""SELECT doc_id, CASE WHEN source_label IN ('material_absent') THEN 'missing' WHEN source_label = 'material_continuous' THEN 'present' WHEN source_label = 'ambiguous' THEN 'uncertain' ELSE automatic END AS adjudicated, automatic AS primary_class
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'material_absent' WHEN quality = 1 THEN 'material_continuous' WHEN quality = 0 THEN 'ambiguous' END AS source_label, CASE WHEN n_chars > 1000 THEN 'present' ELSE 'thin' END AS automatic FROM documents LEFT JOIN labels USING (doc_id))""")
def adjudicated_labels(spark, sf_dir):
    """A reviewer's label overrides the automatic class, which stays beside it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "present").otherwise("thin").alias("automatic"))
    human = F.when(F.col("toxic") == 1, "material_absent").when(F.col("quality") == 1, "material_continuous").when(F.col("quality") == 0, "ambiguous")
    out = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", rules.remapped(human, {k: v[0] for k, v in rules.HUMAN_LABELS.items()}, F.col("automatic")).alias("adjudicated"), F.col("automatic").alias("primary_class"))


# --- graphs -----------------------------------------------------------------------------------------------------------------------

_JUNCTIONS = "j AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_custkey % 97 + 0.5 AS y, c_nationkey + 0.25 AS z FROM customer), s AS (SELECT o_orderkey AS id, o_custkey AS junction0, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS junction1 FROM orders)"


def _junctions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97 + 0.5).alias("y"), (F.col("c_nationkey") + 0.25).alias("z"))


def _struts(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    rows = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("junction0"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("n")).alias("junction1"))


@query(f"""WITH {_JUNCTIONS} SELECT s.id, round((a.x + b.x) / 2, 6) AS mid_x, (a.y + b.y) / 2 AS mid_y, (a.z + b.z) / 2 AS mid_z, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS length
FROM s JOIN j a ON a.id = s.junction0 JOIN j b ON b.id = s.junction1""")
def strut_geometry(spark, sf_dir):
    return rounded(lattice.strut_geometry(_struts(spark, sf_dir), _junctions(spark, sf_dir)), "mid_x", "length").select("id", "mid_x", "mid_y", "mid_z", "length")


@query(f"""WITH {_JUNCTIONS}, p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND (a.junction0 IN (b.junction0, b.junction1) OR a.junction1 IN (b.junction0, b.junction1)) WHERE a.id % 10 = 3 AND b.id % 10 = 3) SELECT count(*) AS pairs FROM p""")
def adjacent_strut_pairs(spark, sf_dir):
    """How many struts of a class share a junction, counted by junctions and not by listing pairs."""
    return joins.shared_node_pair_count(_struts(spark, sf_dir).filter("id % 10 = 3"), "id", "junction0", "junction1")


@query(f"""WITH RECURSIVE {_JUNCTIONS}, e AS (SELECT 2 * id AS s, 2 * junction0 + 1 AS n FROM s WHERE id % 10 = 3 UNION SELECT 2 * id, 2 * junction1 + 1 FROM s WHERE id % 10 = 3), l AS (SELECT s AS u, n AS v FROM e UNION ALL SELECT n, s FROM e),
c(id, l) USING KEY (id) AS (SELECT DISTINCT u, CASE WHEN u % 2 = 0 THEN u ELSE 9000000000000000 + u END FROM l UNION SELECT l.v, min(c.l) FROM c JOIN l ON l.u = c.id JOIN recurring.c AS r ON r.id = l.v WHERE c.l < r.l GROUP BY l.v)
SELECT id // 2 AS id, l // 2 AS component FROM c WHERE id % 2 = 0""")
def strut_clusters(spark, sf_dir):
    """Struts of a class that shared junctions connect, named by their smallest id."""
    return joins.shared_node_components(_struts(spark, sf_dir).filter("id % 10 = 3"), "id", "junction0", "junction1")


@query((_CLUSTERS + ", k AS (SELECT id, min(l) AS component FROM c GROUP BY id), z AS (SELECT component, count(*) AS size FROM k GROUP BY 1) SELECT count(*) AS components, max(size) AS largest, sum(size)::BIGINT AS vertices, round(max(size) / sum(size), 9) AS largest_share FROM z").replace("RADIUS", "6"))
def component_counts(spark, sf_dir):
    found = graph.connected_components(joins.radius_pairs(_points(spark, sf_dir), "id", ["x", "y"], 6.0), "a", "b")
    return rounded(graph.component_sizes(found), "largest_share", places=9)


@query((_CLUSTERS + """, k AS (SELECT id, min(l) AS component FROM c GROUP BY id), z AS (SELECT component, count(*) AS size FROM k GROUP BY 1), m AS (SELECT id, min(d) AS d FROM (SELECT a AS id, d FROM e UNION ALL SELECT b, d FROM e) GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS pairs, count(*) AS clusters, max(size) AS largest, sum(size)::BIGINT AS clustered, (SELECT round(avg(d), 6) FROM m) AS mean_nearest, (SELECT count(*) FROM p) AS points, round(sum(size) / (SELECT count(*) FROM p), 9) AS clustered_share FROM z""").replace("RADIUS", "6"))
def cluster_metrics(spark, sf_dir):
    return rounded(rounded(spatial.cluster_metrics(_points(spark, sf_dir), "id", ["x", "y"], 6.0), "mean_nearest"), "clustered_share", places=9)


@query("""WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), d AS (SELECT p, count(*) AS degree FROM e GROUP BY 1)
SELECT p AS node, CASE degree WHEN 3 THEN 'corner' WHEN 5 THEN 'edge' WHEN 8 THEN 'face' WHEN 12 THEN 'interior' ELSE 'irregular' END AS role FROM d""")
def node_roles(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000000).alias("dst"))
    return graph.degrees(e).filter("id < 100000000").select(F.col("id").alias("node"), geometry.node_role(F.col("degree")).alias("role"))


@query("SELECT count(*) FILTER (WHERE o IS NOT NULL AND c IS NOT NULL) AS n_both, count(*) FILTER (WHERE c IS NULL) AS n_left, count(*) FILTER (WHERE o IS NULL) AS n_right FROM (SELECT DISTINCT o_custkey AS o FROM orders) x FULL JOIN (SELECT c_custkey AS c FROM customer) y ON o = c")
def registered_keys(spark, sf_dir):
    """Keys of a registered graph against those of the nominal one: both, and those of one side alone."""
    left = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("l", F.lit(True))
    right = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("r"))
    return left.join(right, "k", "full").agg(F.count_if(F.col("l") & F.col("r")).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left"), F.count_if(F.col("l").isNull()).alias("n_right"))


@query("SELECT p_partkey, p_size, p_retailprice, p_size * 2 AS twice FROM part")
def zipped_columns(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return joins.zipped(p.select("p_partkey", "p_size"), p.select("p_partkey", "p_retailprice", (F.col("p_size") * 2).alias("twice")), "p_partkey").select("p_partkey", "p_size", "p_retailprice", "twice")


# --- states and gates -------------------------------------------------------------------------------------------------------------

_STATES = """WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 12 END AS expected, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 12 END - CASE WHEN p_partkey % 10 = 0 THEN 1 + p_partkey % 3 ELSE 0 END AS supported, p_retailprice AS volume, (p_partkey * p_partkey) % 101 + 0.5 AS asymmetry FROM part),
m AS (SELECT expected, count(*) AS peers, quantile_cont(volume, 0.5) AS mv, stddev_pop(volume) AS sv, quantile_cont(asymmetry, 0.5) AS ma, stddev_pop(asymmetry) AS sa FROM r GROUP BY 1),
d AS (SELECT expected, quantile_cont(abs(volume - mv), 0.5) AS dv, quantile_cont(abs(asymmetry - ma), 0.5) AS da FROM r JOIN m USING (expected) GROUP BY 1),
z AS (SELECT r.*, peers >= 3 AS compared, peers >= 3 AND ((volume - mv) / CASE WHEN 1.4826 * dv > 1e-6 THEN 1.4826 * dv ELSE greatest(sv, 1e-6) END > 2.5 OR (asymmetry - ma) / CASE WHEN 1.4826 * da > 1e-6 THEN 1.4826 * da ELSE greatest(sa, 1e-6) END > 2.5) AS high FROM r JOIN m USING (expected) JOIN d USING (expected))
SELECT p_partkey, CASE WHEN supported < expected THEN 'junction_under_fused' WHEN high THEN 'junction_enlarged_or_malformed' ELSE 'good' END AS state, round(CASE WHEN supported < expected THEN least(0.95, 0.65 + 0.08 * (expected - supported)) WHEN high THEN 0.7 WHEN compared THEN 0.75 ELSE 0.6 END::DOUBLE, 6) AS confidence, compared AS peers_compared FROM z"""


@query(_STATES)
def junction_states(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    expected = F.when(z % 4 == 0, 3).when(z % 4 == 1, 5).when(z % 4 == 2, 8).otherwise(12)
    rows = read(spark, sf_dir, "part").select("p_partkey", expected.alias("expected"), (expected - F.when(k % 10 == 0, 1 + k % 3).otherwise(0)).alias("supported"), F.col("p_retailprice").alias("volume"), (k * k % 101 + 0.5).alias("asymmetry"))
    return rounded(integrity.junction_states(rows, "expected", "supported", ["volume", "asymmetry"]), "confidence").select("p_partkey", "state", "confidence", "peers_compared")


@query("""WITH d AS (SELECT CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity / 12 END AS d FROM lineitem), g AS (SELECT count(*) AS stations, avg(CASE WHEN d IS NULL THEN 0.0 ELSE 1.0 END) AS found, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90 FROM d)
SELECT stations, round(found, 9) AS found, round(median, 6) AS median, round(p90, 6) AS p90, found >= 0.85 AND median <= 2 AND p90 <= 4 AS reliable FROM g""")
def alignment_gate(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity") / 12).otherwise(float("inf")).alias("d"))
    return rounded(rounded(integrity.alignment_gate(rows, "d"), "median", "p90"), "found", places=9)


@query("SELECT event_type, median FROM (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1) ORDER BY median DESC, event_type LIMIT 1")
def best_order(spark, sf_dir):
    """Of the orders of axes (here: types of events) the one with the largest median intensity."""
    return integrity.best_order(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH c AS (SELECT l_partkey, l_linenumber, CASE WHEN l_partkey % 40 = 7 THEN 0.6 ELSE 0.1 END + (l_linenumber % 3) * 0.01 AS fall FROM lineitem), m AS (SELECT l_partkey, quantile_cont(fall, 0.5) AS median FROM c GROUP BY 1),
n AS (SELECT count(*) AS n FROM m), v AS (SELECT median, count(*) AS k FROM m WHERE median >= 0.1 GROUP BY 1), w AS (SELECT median, sum(k) OVER (ORDER BY median DESC) AS above, coalesce(lead(median) OVER (ORDER BY median DESC), 0.1) AS below FROM v),
b AS (SELECT median AS split FROM w, n WHERE above >= greatest(3, 0.0001 * n) AND above <= 0.05 * n AND median >= 0.2 AND median - below >= 0.1 ORDER BY median - below DESC, median DESC LIMIT 1)
SELECT l_partkey, round(avg(CASE WHEN fall >= split - 0.05 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM c JOIN m USING (l_partkey), b WHERE median >= split GROUP BY 1 HAVING avg(CASE WHEN fall >= split - 0.05 THEN 1.0 ELSE 0.0 END) >= 2.0 / 3 - 1e-9""")
def omission_split(spark, sf_dir):
    """Struts whose coverage falls beyond the widest admissible step, on most radii."""
    fall = F.when(F.col("l_partkey") % 40 == 7, 0.6).otherwise(0.1) + (F.col("l_linenumber") % 3) * 0.01
    return rounded(inspection.removed_by_design(read(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", fall.alias("fall")), "l_partkey", "l_linenumber", "fall"), "agreement")


@query("""WITH c AS (SELECT user_id, event_type AS mode, count(*) AS votes, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, votes, mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS r FROM c) WHERE r = 1""")
def majority_vote_first(spark, sf_dir):
    """Of equally frequent values the one first seen."""
    return ag.mode(read(spark, sf_dir, "events"), "user_id", "event_type", F.col("event_id"))


_UNIFORM = """WITH p AS (SELECT r.range AS replicate, i.range AS id, [20 * (('0x' || substr(md5('9:' || r.range || ':' || i.range || ':0'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE), 20 * (('0x' || substr(md5('9:' || r.range || ':' || i.range || ':1'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE), 10 * (('0x' || substr(md5('9:' || r.range || ':' || i.range || ':2'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)] AS c FROM range(40) r, range(25) i),
e AS (SELECT a.replicate, a.id AS a, b.id AS b FROM p a JOIN p b ON a.replicate = b.replicate AND a.id < b.id AND list_distance(a.c, b.c) <= 3), t AS (SELECT replicate, count(DISTINCT id) AS touched FROM (SELECT replicate, a AS id FROM e UNION ALL SELECT replicate, b FROM e) GROUP BY 1)
SELECT r.range AS replicate, (SELECT count(*) FROM e WHERE e.replicate = r.range) AS pairs, coalesce(touched, 0) / 25 AS clustered_share FROM range(40) r LEFT JOIN t ON t.replicate = r.range"""


@query(_UNIFORM)
def uniform_null(spark, sf_dir):
    """Replicates of points spread evenly over a box; like the lattice template it reads no table."""
    return statistics.uniform_null(spark, 25, [(0.0, 20.0), (0.0, 20.0), (0.0, 10.0)], 3.0, 40)


# --- audits -----------------------------------------------------------------------------------------------------------------------

_GRAPH = """g AS (SELECT c_custkey AS id, c_custkey - c_custkey % 2 AS node FROM customer), s AS (SELECT o_orderkey AS id, o_custkey AS junction0, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS junction1 FROM orders),
w AS (SELECT DISTINCT least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM s JOIN g a ON a.id = junction0 JOIN g b ON b.id = junction1),
x AS (SELECT s.id, CASE WHEN s.id % 400 = 5 THEN -1 ELSE junction0 END AS u, junction1 AS v, CASE WHEN s.id % 300 = 7 THEN -s.id ELSE s.id END AS src FROM s WHERE s.id % 50 <> 3),
m AS (SELECT least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM x LEFT JOIN g a ON a.id = u LEFT JOIN g b ON b.id = v WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
q AS (SELECT (SELECT count(*) FROM x WHERE u = -1) + (SELECT count(*) FROM (SELECT a, b FROM w EXCEPT SELECT a, b FROM m)) + (SELECT count(*) FROM (SELECT DISTINCT a, b FROM m EXCEPT SELECT a, b FROM w)) AS bad)"""


@query(f"""WITH {_GRAPH}, r AS (SELECT 'junctions' AS "check", (SELECT count(*) FROM customer) = 1500 AS ok, 1500 AS expected, (SELECT count(*) FROM customer) AS actual UNION ALL SELECT 'welded nodes', (SELECT count(DISTINCT node) FROM g) = 750, 750, (SELECT count(DISTINCT node) FROM g)
UNION ALL SELECT 'welded struts', (SELECT count(*) FROM w) = 14000, 14000, (SELECT count(*) FROM w) UNION ALL SELECT 'ends are junctions', NOT EXISTS (SELECT 1 FROM x WHERE u = -1), 0, (SELECT count(*) FROM (SELECT DISTINCT u FROM x WHERE u = -1))
UNION ALL SELECT 'edges are the welded struts', bad = 0, 0, bad FROM q UNION ALL SELECT 'source struts exist', NOT EXISTS (SELECT 1 FROM x WHERE src < 0), 0, (SELECT count(*) FROM x WHERE src < 0))
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, expected::DOUBLE AS expected, actual::DOUBLE AS actual FROM r""")
def cross_validation(spark, sf_dir):
    """Claimed edges against the welded graph; some of them are wrong."""
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - F.col("c_custkey") % 2).alias("node"))
    struts = _struts(spark, sf_dir)
    i = F.col("id")
    edges = struts.filter(i % 50 != 3).select(F.concat(F.lit("E"), i).alias("edge_id"), F.when(i % 400 == 5, -1).otherwise(F.col("junction0")).alias("u"), F.col("junction1").alias("v"), F.when(i % 300 == 7, -i).otherwise(i).alias("source_strut_id"))
    return audit.cross_validation(members.select("id"), struts, members, edges, {"junctions": 1500, "nodes": 750, "struts": 14000})


@query("""WITH e AS (SELECT l_linenumber = 1 AS candidate, l_linenumber = 2 AS promoted, l_quantity AS ux, l_partkey % 50 AS vx, l_returnflag = 'R' AS empty, l_discount = 0 AS zero FROM lineitem),
p AS (SELECT value > 200 AS zero, event_type = 'error' OR event_id % 97 = 3 AS off FROM events)
SELECT "check", CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 0.0::DOUBLE AS expected, actual::DOUBLE AS actual FROM (SELECT 'candidates without support' AS "check", count(*) FILTER (WHERE candidate AND ux > 40 AND vx > 40 AND empty AND zero) AS actual FROM e UNION ALL SELECT 'panels without signal', count(*) FILTER (WHERE zero) FROM p
UNION ALL SELECT 'promotions across the boundary', count(*) FILTER (WHERE promoted AND greatest(ux, vx) > 40) FROM e UNION ALL SELECT 'panel values that differ', count(*) FILTER (WHERE off) FROM p)""")
def boundary_conflicts(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "no_local_material").otherwise("registered")
    profile = F.when(F.col("l_discount") == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.col("l_discount")))
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), (F.col("l_linenumber") == 1).alias("candidate"), (F.col("l_linenumber") == 2).alias("promoted"), F.col("l_quantity").alias("u_x"), (F.col("l_partkey") % 50).cast("double").alias("v_x"), status.alias("u_status"), status.alias("v_status"), profile.alias("profile"))
    label = F.when(F.col("event_type") == "error", "mean_delta_mm").otherwise("CT anomaly score")
    panels = read(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.array(F.when(F.col("value") > 200, 0.0).otherwise(1.0)).alias("signals"), label.alias("metric_label"), F.col("value").alias("metric_value"), F.when(F.col("event_id") % 97 == 3, F.col("value") + 1).otherwise(F.col("value")).alias("source_value"))
    return audit.boundary_conflicts(edges, panels, 40.0)


@query(r"""SELECT doc_id, list_filter(['the', 'de'], lambda x: NOT contains(coalesce(text, ''), x)) AS missing, list_filter(['token', 'License'], lambda x: contains(coalesce(text, ''), x)) AS present,
 list_filter(['[0-9]{4}'], lambda x: len(regexp_extract_all(coalesce(text, ''), '[0-9]{4}')) <> 0) AS miscounted FROM documents""")
def text_claims(spark, sf_dir):
    """What each text must say, must not say, and how often; links are held against files in the tests."""
    return audit.text_claims(read(spark, sf_dir, "documents"), "doc_id", "text", ["the", "de"], ["token", "License"], {"[0-9]{4}": 0}).select("doc_id", "missing", "present", "miscounted")


# --- arrays, maps, dates ----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, value < 10 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 10 ORDER BY event_id) AS island FROM events), r AS (SELECT user_id, hit, island, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, coalesce(max(CASE WHEN hit THEN n END), 0) AS longest FROM r GROUP BY 1""")
def array_runs(spark, sf_dir):
    """The longest run in an array of flags, within the row."""
    flags = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") < 10).alias("hit")))), lambda x: x["hit"]).alias("flags"))
    return flags.select("user_id", sequences.longest_run_of_array(F.col("flags"))["length"].cast("long").alias("longest"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS counts, coalesce(max(n) FILTER (WHERE event_type = 'error'), 0) AS errors FROM c GROUP BY 1""")
def counter_maps(spark, sf_dir):
    """Counts of a group as a map, looked up and walked."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    walked = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("m"), k).cast("string"))), ";")
    return maps.select("user_id", walked.alias("counts"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).alias("errors"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, date_trunc('second', ts) = strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') AS same FROM events")
def utc_stamps(spark, sf_dir):
    stamp = tx.utc_stamp(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), (tx.read_stamp(stamp) == F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("same"))


# --- files ------------------------------------------------------------------------------------------------------------------------


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_strict_scan(spark, sf_dir):
    """Written with an exact header, read with the same one, all columns as text."""
    fields, at = ["c_custkey", "c_name", "c_mktsegment"], _place(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name"), at, fields)
    return tables.read_strict_csv(spark, at, fields)


@query("SELECT p_partkey, p_retailprice FROM part")
def csv_projected_scan(spark, sf_dir):
    """Types are inferred, and only the named columns are kept."""
    at = _place(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "part"), at)
    return tables.read_projected_csv(spark, at, ["p_partkey", "p_retailprice"]).select(F.col("p_partkey").cast("long"), F.col("p_retailprice").cast("double"))


@query("""SELECT s_suppkey, '{"acct":' || CASE WHEN s_suppkey % 5 = 0 THEN 'null' ELSE (s_suppkey * 2)::VARCHAR END || ',"name":"' || s_name || '","suppkey":' || s_suppkey || '}' AS line FROM supplier""")
def json_lines_round_trip(spark, sf_dir):
    """Lines with sorted keys and nulls written out."""
    at = _place(spark, "lines")
    tables.write_json_lines(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") * 2).alias("acct")), at)
    return spark.read.text(at).select(F.get_json_object("value", "$.suppkey").cast("long").alias("s_suppkey"), F.col("value").alias("line"))


def _lattice_text(spark, sf_dir) -> DataFrame:
    """One lattice document: nations are junctions, and each is tied to the first of its region."""
    nation = read(spark, sf_dir, "nation")
    junctions = nation.agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_nationkey") * 1.5, F.col("n_regionkey") + 0.25, F.lit(2.0)).alias("position")))).alias("junctions"))
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    struts = nation.join(first, "n_regionkey").filter("n_nationkey <> first").agg(F.array_sort(F.collect_list(F.struct((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("first").cast("long").alias("junction0"), F.col("n_nationkey").cast("long").alias("junction1")))).alias("struts"))
    return junctions.crossJoin(struts).select(F.to_json(F.struct("junctions", "struts")).alias("value"))


_TIES = "t AS (SELECT n_nationkey, n_regionkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation)"


@query(f"WITH {_TIES} SELECT n_nationkey + 1000 AS id, first AS junction0, n_nationkey AS junction1, round(abs(n_nationkey - first) * 1.5, 6) AS length FROM t WHERE n_nationkey <> first")
def lattice_document_scan(spark, sf_dir):
    """A document of junctions and struts is written as JSON, read, checked and joined."""
    at = _place(spark, "lattice")
    _lattice_text(spark, sf_dir).coalesce(1).write.text(at)
    junctions, struts, _ = lattice.read_lattice(spark, at)
    return rounded(lattice.strut_geometry(struts, junctions), "length").select("id", "junction0", "junction1", "length")


@query(f"WITH {_TIES} SELECT 'junction' AS kind, n_nationkey AS id FROM t UNION ALL SELECT 'strut', n_nationkey + 1000 FROM t WHERE n_nationkey <> first AND n_nationkey <> (SELECT max(n_nationkey) FROM t WHERE n_nationkey <> first)")
def lattice_salvage(spark, sf_dir):
    """A document that breaks off in its last strut: all whole records are found."""
    torn = _lattice_text(spark, sf_dir).select(F.expr("substring(value, 1, length(value) - 20)").alias("value"))
    junctions, struts = lattice.salvage(torn)
    return junctions.select(F.lit("junction").alias("kind"), "id").unionByName(struts.select(F.lit("strut").alias("kind"), "id"))


@query("SELECT * FROM (VALUES ('count', '3'), ('name', 'lattice'), ('kept', '[1,2]')) v(key, value)")
def json_document_scan(spark, sf_dir):
    """One JSON object as one row."""
    at = _place(spark, "document")
    spark.range(1).select(F.lit(json.dumps({"name": "lattice", "count": 3, "kept": [1, 2]}, indent=1)).alias("value")).coalesce(1).write.text(at)
    row = tables.read_json_document(spark, at).select(F.col("count").cast("string").alias("count"), "name", F.to_json("kept").alias("kept"))
    return row.select(F.explode(F.map_from_arrays(F.array(F.lit("count"), F.lit("name"), F.lit("kept")), F.array("count", "name", "kept"))).alias("key", "value"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 1000, n_name FROM nation")
def append_unique(spark, sf_dir):
    """Rows are appended only if their keys are new."""
    at = _place(spark, "append")
    read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name").write.parquet(at)
    more = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    tables.append_rows(more, at, "r_regionkey")
    try:
        tables.append_rows(more.limit(1), at, "r_regionkey")
    except ValueError:
        return spark.read.parquet(at)
    raise AssertionError("a repeated key was taken")


_VOXELS = "v AS (SELECT p_partkey // 1000000 AS z, (p_partkey // 1000) % 1000 AS y, p_partkey % 1000 AS x, p_size AS v FROM part)"


def _cells(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(k / 1000000).alias("z"), (F.floor(k / 1000) % 1000).alias("y"), (k % 1000).alias("x"), F.col("p_size").alias("v"))


@query(f"WITH {_VOXELS} SELECT z, y, x - 20 AS x, v FROM v WHERE z >= 0 AND z < 5 AND y >= 0 AND y < 90 AND x >= 20 AND x < 500")
def cropped_voxels(spark, sf_dir):
    return volumes.cropped(_cells(spark, sf_dir), (0, 0, 20), (5, 90, 500))


@query(f"WITH {_VOXELS} SELECT z, y, v FROM v WHERE x = 77")
def voxel_plane(spark, sf_dir):
    return volumes.plane(_cells(spark, sf_dir), "x", 77)


@query(f"WITH {_VOXELS} SELECT z, y, x, max(CASE WHEN c = 0 THEN v END) AS red, max(CASE WHEN c = 1 THEN v END) AS green FROM (SELECT z, y, x // 2 AS x, x % 2 AS c, v FROM v) GROUP BY 1, 2, 3")
def channel_merge(spark, sf_dir):
    """Channels are split into rows and merged again."""
    cells = _cells(spark, sf_dir).select("z", "y", F.floor(F.col("x") / 2).alias("x"), (F.col("x") % 2).alias("c"), "v")
    merged = volumes.merged_channels(cells, "c", ["red", "green"])
    return volumes.merged_channels(volumes.split_channels(merged, ["red", "green"]), "c", ["red", "green"])


_MASK = _VOXELS + """, m AS (SELECT z, y, x, z * 1000000000 + y * 10000 + x AS k FROM v WHERE v > 20), n AS (SELECT a.k AS u, b.k AS w FROM m a JOIN m b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.k <> b.k),
c(id, l) USING KEY (id) AS (SELECT k, k FROM m UNION SELECT n.w, min(c.l) FROM c JOIN n ON n.u = c.id JOIN recurring.c AS r ON r.id = n.w WHERE c.l < r.l GROUP BY n.w),
o AS (SELECT z, y, x, l, count(*) OVER (PARTITION BY l) AS size FROM c JOIN m ON m.k = c.id)"""


def _masked(spark, sf_dir) -> DataFrame:
    return voxels.mask_components(_cells(spark, sf_dir).filter("v > 20"), least=3)


@query(f"WITH RECURSIVE {_MASK} SELECT z, y, x, l AS component, size FROM o WHERE size >= 3")
def mask_components(spark, sf_dir):
    """Components of a mask over all its voxels, small ones left out."""
    k = F.col("component")
    return _masked(spark, sf_dir).select("z", "y", "x", (k["z"] * 1000000000 + k["y"] * 10000 + k["x"]).alias("component"), "size")


@query(f"""WITH RECURSIVE {_MASK}, t AS (SELECT l, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, (max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM o WHERE size >= 3 GROUP BY l), r AS (SELECT l, box, sqrt((z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2) AS d FROM o JOIN t USING (l))
SELECT l AS component, count(*) AS volume, round(2 * (3 * count(*) / (4 * pi())) ** (1.0 / 3), 6) AS equivalent_diameter, round(count(*) / any_value(box), 9) AS compactness, round(stddev_pop(d) / greatest(avg(d), 1e-6), 6) AS radial_asymmetry FROM r GROUP BY 1""")
def component_shapes(spark, sf_dir):
    k = F.col("component")
    named = _masked(spark, sf_dir).select("z", "y", "x", (k["z"] * 1000000000 + k["y"] * 10000 + k["x"]).alias("component"))
    return rounded(rounded(voxels.component_shapes(named, "component"), "equivalent_diameter", "radial_asymmetry"), "compactness", places=9)


_DIMENSIONS = ("l_returnflag", "l_linestatus", "l_linenumber % 3", "l_partkey % 3", "l_suppkey % 3")


@query("WITH d AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, ({d})::VARCHAR AS stratum, CASE WHEN l_tax > 0.01 THEN l_quantity > 12 END AS s FROM lineitem" for d in _DIMENSIONS) + """), g AS (SELECT dimension, stratum, count(*) AS positives, count(*) FILTER (WHERE s) AS successes FROM d GROUP BY 1, 2)
SELECT *, round(successes / positives, 9) AS sensitivity, positives >= 10 AS powered, NOT positives >= 10 OR successes / positives >= 0.6 AS passed FROM g""")
def powered_gates(spark, sf_dir):
    """Five dimensions at once; an unknown success is a miss."""
    success = F.when(F.col("l_tax") > 0.01, F.col("l_quantity") > 12)
    return rounded(statistics.powered_gates(read(spark, sf_dir, "lineitem"), {d: F.expr(d) for d in _DIMENSIONS}, success, sensitivity=0.6), "sensitivity", places=9)


@query("""WITH g AS (SELECT l_suppkey, l_suppkey % 3 AS model, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem GROUP BY 1),
p AS (SELECT *, round(exp(-k::DOUBLE / 10), 9) AS attraction, CASE WHEN l_suppkey % 7 <> 0 THEN round(exp(-a::DOUBLE / 10), 9) END AS avoidance FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY attraction) AS ra, count(*) OVER (PARTITION BY model) AS na, row_number() OVER (PARTITION BY model, avoidance IS NULL ORDER BY avoidance) AS rv, count(avoidance) OVER (PARTITION BY model) AS nv FROM p)
SELECT l_suppkey, round(least(1.0, min(attraction * na / ra) OVER (PARTITION BY model ORDER BY ra DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_attraction,
 CASE WHEN avoidance IS NOT NULL THEN round(least(1.0, min(avoidance * nv / rv) OVER (PARTITION BY model, avoidance IS NULL ORDER BY rv DESC ROWS UNBOUNDED PRECEDING)), 6) END AS q_avoidance FROM r""")
def association_tests(spark, sf_dir):
    """Corrected p values, each model and direction a family of its own."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    p = g.select("l_suppkey", (F.col("l_suppkey") % 3).alias("model"), F.round(F.exp(-F.col("k") / 10), 9).alias("attraction"), F.when(F.col("l_suppkey") % 7 != 0, F.round(F.exp(-F.col("a") / 10), 9)).alias("avoidance"))
    return rounded(statistics.association_tests(p, ["attraction", "avoidance"], "model").select("l_suppkey", "q_attraction", "q_avoidance"), "q_attraction", "q_avoidance")


@query("""WITH t AS (SELECT p_partkey AS id, 0.5 * (1 + p_size) * (1 + p_partkey % 4) AS area FROM part), n AS (SELECT id, 0.3 * area AS many, ('0x' || substr(md5('9:' || id || ':more'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM t), c AS (SELECT id, floor(many) + CASE WHEN u < many - floor(many) THEN 1 ELSE 0 END AS n FROM n)
SELECT id, n::BIGINT AS points, n::BIGINT AS inside FROM c WHERE n > 0""")
def surface_samples(spark, sf_dir):
    """How many points fall on each triangle, by its area, and that all of them lie within it."""
    k, w, h = F.col("p_partkey"), (1 + F.col("p_size")).cast("double"), (1 + F.col("p_partkey") % 4).cast("double")
    zero = F.lit(0.0)
    corners = {"ax": zero, "ay": zero, "az": zero, "bx": w, "by": zero, "bz": zero, "cx": zero, "cy": h, "cz": zero}
    triangles = read(spark, sf_dir, "part").select(k.alias("id"), *[c.alias(n) for n, c in corners.items()])
    points = voxels.surface_samples(triangles, "id", 0.3).join(triangles.select("id", F.col("bx").alias("w"), F.col("cy").alias("h")), "id")
    within = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") / F.col("w") + F.col("y") / F.col("h") <= 1 + 1e-9) & (F.col("z") == 0)
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.count_if(within).alias("inside"))
