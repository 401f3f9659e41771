"""Positions, regions, orientations and lattice arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def boundary_region(mid: Sequence[Column], low: Sequence[Column | float], high: Sequence[Column | float], width: float) -> Column:
    """corner, edge, face or interior: on how many axes the point lies within `width` of a face."""
    near = sum(((F.least(m - lo, hi - m) <= width + 1e-9).cast("int") for m, lo, hi in zip(mid, low, high, strict=True)), F.lit(0))
    return F.when(near >= 3, "corner").when(near == 2, "edge").when(near == 1, "face").otherwise("interior")


def face_distances(mid: Sequence[Column], low: Sequence, high: Sequence) -> dict[str, Column]:
    d = F.array_sort(F.array(*[F.least(m - lo, hi - m) for m, lo, hi in zip(mid, low, high, strict=True)]))
    return {"face": d[0], "edge": F.hypot(d[0], d[1]), "corner": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])}


def layer(mid: Column, low, cell: float, n: int = 9) -> Column:
    """Which of n layers of cells a position lies in, held to the first and the last."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((mid - low) / cell))).cast("int")


def third(value: Column, low, high) -> Column:
    """0, 1 or 2: thirds of the range, half-open, the largest value in the last; 0 for an empty range."""
    return F.when(high > low, F.least(F.floor(3 * (value - low) / (high - low)), F.lit(2))).otherwise(0).cast("int")


def exterior(n: Sequence[Column], depth: float = 0.18) -> Column:
    """Whether a normalised position lies within `depth` of a face."""
    return F.least(*[F.least(x, 1 - x) for x in n]) < depth


def height_band(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("low", "middle", "high")]), F.greatest(F.lit(0), F.least(F.lit(2), F.floor(3 * n))).cast("int") + 1)


def orientation_key(delta: Sequence[Column]) -> Column:
    """`a:b:c` of the undirected direction: twice the unit vector, rounded half to even, first notable component positive."""
    length = F.sqrt(sum((d * d for d in delta), F.lit(0.0)))
    unit = [d / length for d in delta]
    sign = F.coalesce(*[F.when(F.abs(u) > 1e-6, F.signum(u)) for u in unit], F.lit(1.0))
    return F.when(length > 0, F.concat_ws(":", *[F.rint(2 * u * sign).cast("int").cast("string") for u in unit]))


def axis_family(delta: Sequence[Column], names: str = "xyz") -> Column:
    """Axes that a direction moves along, with signs up to reversal, such as +x-y."""
    sign = F.coalesce(*[F.when(F.abs(d) > 1e-6, F.signum(d)) for d in delta], F.lit(1.0))
    return F.concat(*[F.when(F.abs(d) <= 1e-6, "").when(d * sign > 0, f"+{a}").otherwise(f"-{a}") for d, a in zip(delta, names, strict=True)])


def in_field(start: Sequence[Column], stop: Sequence[Column], shape: Sequence[int]) -> Column:
    out = F.lit(True)
    for a, b, n in zip(start, stop, shape, strict=True):
        out = out & (F.least(a, b) >= 0) & (F.greatest(a, b) < n)
    return out


def transformed(point: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """A 4 x 4 homogeneous transform of columns x, y, z, with the homogeneous divide."""
    rows = [sum((F.lit(float(m)) * p for m, p in zip(row, [*point, F.lit(1.0)], strict=True)), F.lit(0.0)) for row in matrix]
    return [r / rows[3] for r in rows[:3]]


def node_role(degree: Column) -> Column:
    """Role of a node in an octet lattice by its degree."""
    return F.when(degree == 3, "corner").when(degree == 5, "edge").when(degree == 8, "face").when(degree == 12, "interior").otherwise("irregular")


def octet_nodes(spark: SparkSession, cells: int) -> DataFrame:
    """Nodes of a face-centred cubic lattice of cells^3 cells on doubled integer coordinates i, j, k (their sum is even)."""
    n = 2 * cells + 1
    grid = spark.range(n * n * n).select((F.col("id") / (n * n)).cast("long").alias("i"), (F.floor(F.col("id") / n) % n).alias("j"), (F.col("id") % n).alias("k"))
    return grid.filter((F.col("i") + F.col("j") + F.col("k")) % 2 == 0)


def octet_edges(spark: SparkSession, cells: int) -> DataFrame:
    """Undirected template edges: nodes at squared distance 2 on doubled coordinates. Made by steps, not by comparing nodes."""
    steps = [(di, dj, dk) for di in (-1, 0, 1) for dj in (-1, 0, 1) for dk in (-1, 0, 1) if di * di + dj * dj + dk * dk == 2 and (di, dj, dk) > (0, 0, 0)]
    nodes = octet_nodes(spark, cells)
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("di", "dj", "dk"), strict=True)]) for s in steps]))
    out = nodes.withColumn("s", step).select("i", "j", "k", *[(F.col(a) + F.col(f"s.d{a}")).alias(f"{a}2") for a in "ijk"])
    inside = [F.col(f"{a}2").between(0, 2 * cells) for a in "ijk"]
    return out.filter(inside[0] & inside[1] & inside[2])


def raster_points(start: Sequence[Column], stop: Sequence[Column], steps: Column) -> Column:
    """Array of integer grid points along a line, without repeats."""
    at = F.sequence(F.lit(0), steps)
    point = lambda t: F.struct(*[F.rint(a + (b - a) * t / F.greatest(steps, F.lit(1))).cast("long").alias(n) for a, b, n in zip(start, stop, ("x", "y", "z"), strict=False)])
    return F.array_distinct(F.transform(at, point))


def owners(points: DataFrame, cell: Sequence[str], owner: str) -> DataFrame:
    """The owner of each grid cell; -1 where several claim it."""
    g = points.groupBy(*cell).agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"))
    return g.select(*cell, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(-1)).alias("owner"))


def stations(length: Column, spacing: float = 0.5, least: int = 9) -> Column:
    """Evenly spaced fractions from 0.1 to 0.9 of a line."""
    n = F.greatest(F.lit(least), F.ceil(length / spacing).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: 0.1 + 0.8 * k / (n - 1))


def enclosed_volume(triangles: DataFrame) -> DataFrame:
    """Signed volume and area of a closed mesh from columns ax .. cz."""
    a, b, c = ([F.col(f"{v}{x}") for x in "xyz"] for v in "abc")
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return triangles.agg((F.sum(det) / 6).alias("volume"), F.sum(0.5 * F.sqrt(sum((x * x for x in cross), F.lit(0.0)))).alias("area"), F.count(F.lit(1)).alias("triangles"))


def on_skin(start: Column, stop: Column, low, high, tolerance: float = 1e-9) -> Column:
    """Whether both ends lie in the lowest or both in the highest plane."""
    near = lambda v, plane: F.abs(v - plane) <= tolerance
    return (near(start, low) & near(stop, low)) | (near(start, high) & near(stop, high))
