"""Checks over tables, each one row: check, status (PASS, FAIL, WARN, SKIP), expected, actual. A table that is not there is SKIP, never FAIL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, ok: Column, expected: Column, actual: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"))


def skipped(spark, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("check"), F.lit("SKIP").alias("status"), F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"))


def row_count(df: DataFrame, name: str, claimed: int) -> DataFrame:
    return _row(df.agg(F.count(F.lit(1)).alias("n")), name, F.col("n") == claimed, F.lit(claimed), F.col("n"))


def unique(df: DataFrame, name: str, *keys: str) -> DataFrame:
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    return _row(one, name, F.col("bad") == 0, F.lit(0), F.col("bad"))


def refers(df: DataFrame, name: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    loose = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    return _row(loose, name, F.col("bad") == 0, F.lit(0), F.col("bad"))


def in_domain(df: DataFrame, name: str, column: str, low: float, high: float) -> DataFrame:
    c = F.col(column).cast("double")
    bad = df.agg(F.count_if(c.isNull() | F.isnan(c) | ~c.between(low, high)).alias("bad"))
    return _row(bad, name, F.col("bad") == 0, F.lit(0), F.col("bad"))


def identity(df: DataFrame, name: str, left: Column, right: Column, tolerance: float = 5e-7) -> DataFrame:
    """Two aggregates that must agree."""
    one = df.agg(left.cast("double").alias("l"), right.cast("double").alias("r"))
    return _row(one, name, F.coalesce(F.abs(F.col("l") - F.col("r")) <= tolerance, F.lit(False)), F.col("l"), F.col("r"))


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Equal as multisets."""
    keys = [c for c in a.columns]
    both = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1)))
    one = both.groupBy(*keys).agg(F.sum("__d").alias("d")).agg(F.count_if(F.col("d") != 0).alias("bad"))
    return _row(one, name, F.col("bad") == 0, F.lit(0), F.col("bad"))


def manifest(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """path, state of every path of two (path, size, sha256) tables: ok, missing, orphan, unsafe, size, hash."""
    c = claimed.select("path", F.col("size").alias("size_c"), F.col("sha256").alias("sha_c"), F.lit(True).alias("in_c"))
    a = actual.select("path", F.col("size").alias("size_a"), F.col("sha256").alias("sha_a"), F.lit(True).alias("in_a"))
    state = (
        F.when(F.col("in_c").isNull(), "orphan")
        .when(F.col("path").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), "unsafe")
        .when(F.col("in_a").isNull(), "missing")
        .when(F.col("size_c") != F.col("size_a"), "size")
        .when(F.col("sha_c") != F.col("sha_a"), "hash")
        .otherwise("ok")
    )
    return c.join(a, "path", "full").select("path", state.alias("state"))


def coverage(ids: DataFrame, column: str, known: DataFrame, key: str, separator: str = r"\|") -> DataFrame:
    """Ids in a joined list that the known table lacks, with how often they occur."""
    used = ids.select(F.explode(F.split(F.coalesce(column, F.lit("")), separator)).alias("id")).select(F.trim("id").alias("id")).filter("id <> ''")
    return used.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(known.select(F.col(key).cast("string").alias("id")).distinct(), "id", "left_anti")


def row_claims(claims: DataFrame, actual: DataFrame) -> DataFrame:
    """Claimed and counted rows of each table: (name, claimed, counted, status); a table that is not there is SKIP."""
    state = F.when(F.col("counted").isNull(), "SKIP").when(F.col("claimed") == F.col("counted"), "PASS").otherwise("FAIL")
    return claims.select("name", "claimed").join(actual.select("name", "counted"), "name", "left").withColumn("status", state)


def cross_validation(junctions: DataFrame, struts: DataFrame, members: DataFrame, edges: DataFrame, claims: Mapping[str, int]) -> DataFrame:
    """Checks of claimed edges against a welded graph, six rows.

    junctions (id), struts (id, junction0, junction1), members (id, node) of the weld, edges (edge_id, u, v, source_strut_id) as claimed;
    claims: how many `junctions`, `nodes` and `struts` there should be. An edge whose ends no junction has counts as different."""
    welded = struts.join(members.select(F.col("id").alias("junction0"), F.col("node").alias("a")), "junction0").join(members.select(F.col("id").alias("junction1"), F.col("node").alias("b")), "junction1")
    ours = welded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    mapped = edges.join(members.select(F.col("id").alias("u"), F.col("node").alias("x")), "u", "left").join(members.select(F.col("id").alias("v"), F.col("node").alias("y")), "v", "left")
    theirs = mapped.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("x").isNull() | F.col("y").isNull()).alias("unmapped"))
    sides = theirs.filter("not unmapped").select("a", "b", F.lit(1).alias("s")).distinct().unionByName(ours.withColumn("s", F.lit(2))).groupBy("a", "b").agg(F.sum("s").alias("s"))
    wrong = sides.agg(F.count_if(F.col("s") != 3).alias("d")).crossJoin(theirs.agg(F.count_if("unmapped").alias("n"))).select((F.col("d") + F.col("n")).alias("bad"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return report(
        row_count(junctions, "junctions", claims["junctions"]),
        row_count(members.select("node").distinct(), "welded nodes", claims["nodes"]),
        row_count(ours, "welded struts", claims["struts"]),
        refers(ends, "ends are junctions", "id", junctions, "id"),
        _row(wrong, "edges are the welded struts", F.col("bad") == 0, F.lit(0), F.col("bad")),
        refers(edges, "source struts exist", "source_strut_id", struts, "id"),
    )


def boundary_conflicts(edges: DataFrame, panels: DataFrame, support: float) -> DataFrame:
    """Checks of evidence against the boundary up to which there is any, four rows with the number of conflicts.

    edges: edge_id, candidate, promoted (boolean), u_x, v_x, u_status, v_status, profile (array of double); panels: edge_id, signals (array of
    double), metric_label, metric_value, source_value. A candidate conflicts if both its ends lie beyond `support`, neither found material, and
    its profile is all zero."""
    beyond = (F.col("u_x") > support) & (F.col("v_x") > support)
    empty = (F.col("u_status") == "no_local_material") & (F.col("v_status") == "no_local_material")
    zero = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x == 0)
    counts = {
        "candidates without support": (edges, F.col("candidate") & beyond & empty & zero("profile")),
        "panels without signal": (panels, zero("signals")),
        "promotions across the boundary": (edges, F.col("promoted") & (F.greatest("u_x", "v_x") > support)),
        "panel values that differ": (panels, (F.col("metric_label") != "CT anomaly score") | ~F.col("metric_value").eqNullSafe(F.col("source_value"))),
    }
    rows = []
    for name, (df, bad) in counts.items():
        one = df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"))
        rows.append(_row(one, name, F.col("bad") == 0, F.lit(0), F.col("bad")))
    return report(*rows)


_LINK = r"\[[^\]]+\]\(([^)]+)\)"


def text_claims(texts: DataFrame, key: str, text: str, required: Sequence[str] = (), forbidden: Sequence[str] = (), counted: Mapping[str, int] | None = None, files: DataFrame | None = None) -> DataFrame:
    """What reports say: (key, missing, present, miscounted, loose_links, status) of each text.

    missing: required phrases that are not there; present: forbidden ones that are; miscounted: patterns that do not occur as often as
    claimed; loose_links: local targets of Markdown links that the table of files (path) lacks (null without such a table)."""
    t = F.coalesce(F.col(text), F.lit(""))
    among = lambda phrases, there: F.array_compact(F.array(*[F.when(t.contains(x) == there, F.lit(x)) for x in phrases]).cast("array<string>"))
    off = F.array_compact(F.array(*[F.when(F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))) != n, F.lit(p)) for p, n in (counted or {}).items()]).cast("array<string>"))
    out = texts.select(F.col(key), among(required, False).alias("missing"), among(forbidden, True).alias("present"), off.alias("miscounted"))
    if files is None:
        out = out.withColumn("loose_links", F.lit(None).cast("array<string>"))
    else:
        target = F.regexp_replace(F.trim("target"), r"^<(.*)>$", "$1")
        links = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(_LINK), F.lit(1)))).alias("target")).filter(~F.trim("target").rlike("^(?:https?://|#)")).select(F.col(key), target.alias("path"))
        loose = links.join(files.select("path").distinct(), "path", "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("loose_links"))
        out = out.join(loose, key, "left").withColumn("loose_links", F.coalesce("loose_links", F.array().cast("array<string>")))
    parts = [F.size(c) for c in ("missing", "present", "miscounted")] + [F.coalesce(F.size("loose_links"), F.lit(0)) if files is not None else F.lit(0)]
    return out.withColumn("status", F.when(sum(parts[1:], parts[0]) == 0, "PASS").otherwise("FAIL"))


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """Counts by status, and the worst one as the overall verdict."""
    counts: Mapping[str, Column] = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "WARN", "SKIP")}
    one = checks.agg(*counts.values())
    return one.withColumn("verdict", F.when(F.col("fail") > 0, "FAIL").when(F.col("warn") > 0, "WARN").when(F.col("pass") > 0, "PASS").otherwise("SKIP"))
