"""Measurements of small regions of a volume: NumPy kernels, and their use on chunk tables.

A strut is measured on the chunk that holds it with enough halo, so one task needs one chunk at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.sources.shared import materialize
from quarry.sources.volumes import array_of


def trilinear(volume: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Values at z, y, x points; NaN outside."""
    top = np.array(volume.shape) - 1
    inside = ((points >= 0) & (points <= top)).all(1)
    out = np.full(len(points), np.nan)
    p = points[inside]
    lo = np.minimum(np.floor(p).astype(int), np.maximum(top - 1, 0))
    f = p - lo
    total = np.zeros(len(p))
    for corner in np.ndindex(2, 2, 2):
        c = np.array(corner)
        weight = np.where(c == 1, f, 1 - f).prod(1)
        z, y, x = np.minimum(lo + c, top).T
        total += weight * volume[z, y, x]
    out[inside] = total
    return out


def half_crossings(profile: np.ndarray, background: float, peak: float) -> tuple[float, float] | None:
    """Where a profile crosses the middle between background and peak, left and right of its largest value; null if it does not on a side."""
    level, k = (background + peak) / 2, int(np.nanargmax(profile))
    if not profile[k] > level:
        return None
    left, right = k, k
    while left > 0 and profile[left - 1] >= level:
        left -= 1
    while right < len(profile) - 1 and profile[right + 1] >= level:
        right += 1
    if left == 0 or right == len(profile) - 1:
        return None
    at = lambda a, b: (level - profile[a]) / (profile[b] - profile[a])
    return left - 1 + at(left - 1, left), right + at(right, right + 1)


def plane_axes(direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors at right angles to a direction and to each other."""
    d = direction / np.linalg.norm(direction)
    helper = np.eye(3)[np.argmin(np.abs(d))]
    u = np.cross(d, helper)
    u /= np.linalg.norm(u)
    return u, np.cross(d, u)


def support(volume: np.ndarray, start: np.ndarray, stop: np.ndarray, threshold: float, radius: float = 1.5, count: int | None = None) -> np.ndarray:
    """Of each station along the middle 80 % of a line, whether any sample within `radius` of it reaches the threshold."""
    length = float(np.linalg.norm(stop - start))
    n = count or max(9, int(np.ceil(length / 0.5)) + 1)
    u, v = plane_axes(stop - start)
    rings = [(0.0, 0.0)] + [(r * np.cos(a), r * np.sin(a)) for r in (radius / 2, radius) for a in np.linspace(0, 2 * np.pi, 8, endpoint=False)]
    stations = start + np.linspace(0.1, 0.9, n)[:, None] * (stop - start)
    points = (stations[:, None, :] + np.array([a * u + b * v for a, b in rings])[None]).reshape(-1, 3)
    values = trilinear(volume, points).reshape(n, -1)
    return np.nanmax(np.where(np.isnan(values), -np.inf, values), axis=1) >= threshold


def longest_gap(flags: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], flags, [True])).astype(int)))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def diameters(volume: np.ndarray, start: np.ndarray, stop: np.ndarray, background: float, peak: float, reach: float = 8.0, step: float = 0.25, rays: int = 4) -> np.ndarray:
    """Widths between half-height crossings at each station, the median over rays; NaN where no ray crosses on both sides."""
    u, v = plane_axes(stop - start)
    offsets = np.arange(-reach, reach + step / 2, step)
    out = []
    for t in np.linspace(0.2, 0.8, 7):
        centre, widths = start + t * (stop - start), []
        for a in np.linspace(0, np.pi, rays, endpoint=False):
            ray = centre + offsets[:, None] * (np.cos(a) * u + np.sin(a) * v)
            values = trilinear(volume, ray)
            values = np.where(np.isnan(values), background, values)
            if found := half_crossings(values, background, peak):
                widths.append((found[1] - found[0]) * step)
        out.append(np.median(widths) if widths else np.nan)
    return np.array(out)


def measure(volume: np.ndarray, start: Sequence[float], stop: Sequence[float], threshold: float, factors: Sequence[float] = (0.9, 1.0, 1.1)) -> dict:
    """Occupancy, longest gap (share of stations), agreement of the coarse state over thresholds, median diameter."""
    a, b = np.asarray(start, float), np.asarray(stop, float)
    states, base = [], None
    for f in factors:
        flags = support(volume, a, b, threshold * f)
        occupancy, gap = float(flags.mean()), longest_gap(flags) / len(flags)
        states.append("missing" if occupancy <= 0.25 else "broken" if occupancy <= 0.85 and gap >= 0.15 else "intact")
        if f == 1.0:
            base = occupancy, gap, states[-1]
    low, high = float(np.percentile(volume, 5)), float(np.percentile(volume, 99.5))
    wide = diameters(volume, a, b, low, high)
    return {"occupancy": base[0], "gap_fraction": base[1], "coarse_state": base[2], "threshold_stability": states.count(base[2]) / len(states), "diameter_median": float(np.nanmedian(wide)) if np.isfinite(wide).any() else None}


def measure_struts(chunks: DataFrame, struts: DataFrame, threshold: float) -> DataFrame:
    """strut_id with its measurements. struts: strut_id, vol, and both ends as z, y, x; each is measured in a chunk that holds both ends.

    A strut that no chunk holds at both ends comes back without measurements and with coarse_state `not covered`."""
    ends = [f"{e}_{c}" for e in ("start", "stop") for c in "zyx"]
    holds = F.lit(True)
    for c in "zyx":
        low, high = F.least(f"start_{c}", f"stop_{c}"), F.greatest(f"start_{c}", f"stop_{c}")
        holds = holds & (low >= F.col(f"{c}0")) & (high <= F.col(f"{c}0") + F.col(f"n{c}") - 1)
    # only numbers take part in the search for the chunk; its data comes afterwards, by key
    place = chunks.select("vol", "z0", "y0", "x0", "nz", "ny", "nx")
    best = struts.join(place, "vol").filter(holds).groupBy("strut_id", "vol", *ends).agg(F.min(F.struct("z0", "y0", "x0")).alias("at"))
    named = best.select("strut_id", "vol", *ends, "at.z0", "at.y0", "at.x0")
    shape = "strut_id long, occupancy double, gap_fraction double, coarse_state string, threshold_stability double, diameter_median double"

    def run(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(parts):
            row = parts.iloc[0]
            volume, base = array_of(row).astype(float), np.array([row["z0"], row["y0"], row["x0"]])
            for s in own.to_dict("records"):
                found = measure(volume, [s[f"start_{c}"] for c in "zyx"] - base, [s[f"stop_{c}"] for c in "zyx"] - base, threshold)
                rows.append({"strut_id": s["strut_id"], **found})
        return pd.DataFrame(rows, columns=[x.split()[0] for x in shape.split(", ")])

    keys = ["vol", "z0", "y0", "x0"]
    found = named.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInPandas(run, shape)
    lost = struts.join(best.select("strut_id"), "strut_id", "left_anti").select("strut_id")
    empty = [F.lit("not covered" if name == "coarse_state" else None).cast(kind).alias(name) for name, kind in (x.split() for x in shape.split(", ")[1:])]
    return found.unionByName(lost.select("strut_id", *empty))


def label_26(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Components of a mask under 26 neighbours, numbered in scan order.

    Runs along x are united with runs of the lines before that they touch, so Python looks at runs and not at voxels."""
    nz, ny, nx = mask.shape
    flat = np.zeros((nz * ny, nx + 2), np.int8)
    flat[:, 1:-1] = mask.reshape(nz * ny, nx)
    line, start = np.nonzero(np.diff(flat, axis=1) == 1)
    _, stop = np.nonzero(np.diff(flat, axis=1) == -1)
    parent = list(range(len(line)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(line, np.arange(nz * ny + 1)).tolist()
    for z in range(nz):
        for y in range(ny):
            here = z * ny + y
            for dz, dy in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
                if z + dz < 0 or not 0 <= y + dy < ny:
                    continue
                i, j = first[here], first[here + dz * ny + dy]
                end, last = first[here + 1], first[here + dz * ny + dy + 1]
                while i < end and j < last:
                    if start[i] <= stop[j] and start[j] <= stop[i]:  # also corner to corner
                        p, q = root(i), root(j)
                        parent[max(p, q)] = min(p, q)
                    if stop[i] < stop[j]:
                        i += 1
                    else:
                        j += 1
    roots = np.array([root(k) for k in range(len(line))], int)
    number = np.zeros(len(line) + 1, int)
    kept = np.unique(roots)
    number[kept] = np.arange(1, len(kept) + 1)
    out = np.zeros(mask.shape, int).reshape(nz * ny, nx)
    for k, (at, lo, hi) in enumerate(zip(line.tolist(), start.tolist(), stop.tolist(), strict=True)):
        out[at, lo:hi] = number[roots[k]]
    return out.reshape(mask.shape), len(kept)


def mask_components(cells: DataFrame, least: int = 1) -> DataFrame:
    """(z, y, x, component, size) of sparse voxels (z, y, x) under 26 neighbours, whatever chunks they came from; components of fewer than `least`
    voxels are left out. A component is named by the least key of its voxels.

    Runs along x are found by rank first; only they are linked, with runs of the 4 neighbouring lines that come before, by slices of x."""
    voxels = cells.select(*[F.col(c).cast("long").alias(c) for c in "zyx"]).distinct()
    rank = F.row_number().over(Window.partitionBy("z", "y").orderBy("x"))
    of_run = voxels.withColumn("run", F.col("x") - rank)
    runs = of_run.groupBy("z", "y", "run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    runs = materialize(runs.withColumn("id", F.monotonically_increasing_id()), "runs")
    # a run meets others in slices of 64 along x, widened by one voxel on the side that looks
    slices = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 64), F.floor(hi / 64)))
    there = runs.select("z", "y", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("id").alias("b"), slices(F.col("lo"), F.col("hi")).alias("s"))
    step = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in ((0, -1), (-1, -1), (-1, 0), (-1, 1))]))
    looks = runs.select("z", "y", "lo", "hi", F.col("id").alias("a"), step.alias("d")).select((F.col("z") + F.col("d.dz")).alias("z"), (F.col("y") + F.col("d.dy")).alias("y"), "lo", "hi", "a", slices(F.col("lo") - 1, F.col("hi") + 1).alias("s"))
    links = looks.join(there, ["z", "y", "s"]).filter("lo <= hi2 + 1 and lo2 <= hi + 1").select("a", "b").distinct()
    found = connected_components(links, "a", "b").withColumnRenamed("component", "root")
    named = materialize(runs.join(found, "id", "left").select("z", "y", "run", "lo", "hi", F.coalesce("root", "id").alias("root")), "named")
    sizes = named.groupBy("root").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("size"), F.min(F.struct("z", "y", F.col("lo").alias("x"))).alias("component")).filter(F.col("size") >= least)
    return of_run.join(named.join(sizes, "root").select("z", "y", "run", "component", "size"), ["z", "y", "run"]).select("z", "y", "x", "component", "size")


def component_shapes(components: DataFrame, *key: str) -> DataFrame:
    """Of each component (key; voxels z, y, x): volume, diameter of the ball of that volume, compactness (share of its box that it fills), and radial
    asymmetry (deviation of the distances to the centroid, over their mean)."""
    axes = "zyx"
    centre = components.groupBy(*key).agg(*[F.avg(c).alias(f"c{c}") for c in axes], *[(F.max(c) - F.min(c) + 1).alias(f"w{c}") for c in axes])
    distance = F.sqrt(sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in axes), F.lit(0.0)))
    one = components.join(centre, list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("volume"), F.first(F.col("wz") * F.col("wy") * F.col("wx")).alias("box"), F.avg(distance).alias("mean"), F.stddev_pop(distance).alias("std"))
    return one.select(*key, "volume", (2 * F.pow(3 * F.col("volume") / (4 * math.pi), 1 / 3)).alias("equivalent_diameter"), (F.col("volume") / F.col("box")).alias("compactness"), (F.col("std") / F.greatest("mean", F.lit(1e-6))).alias("radial_asymmetry"))


def surface_samples(triangles: DataFrame, key: str, density: float, seed: int = 9) -> DataFrame:
    """(key, n, x, y, z): points spread evenly over triangles (ax .. cz), `density` for each unit of area: its whole part, and one more by the rest as a
    digest of the key says. Within a triangle the digest of key and number gives the place."""
    a, b, c = ([F.col(f"{v}{x}") for x in "xyz"] for v in "abc")
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    many = density * 0.5 * F.sqrt(sum((x * x for x in cross), F.lit(0.0)))
    chance = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    own = F.col(key).cast("string")
    n = (F.floor(many) + (chance(own, F.lit("more")) < many - F.floor(many)).cast("long")).cast("int")
    each = triangles.withColumn("__n", n).filter("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    r, t = F.sqrt(chance(own, F.col("__k").cast("string"), F.lit("r"))), chance(own, F.col("__k").cast("string"), F.lit("t"))
    return each.select(F.col(key), F.col("__k").alias("n"), *[((1 - r) * p + r * (1 - t) * q + r * t * w).alias(x) for p, q, w, x in zip(a, b, c, "xyz", strict=True)])


def bridged(mask: np.ndarray, a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    labels, _ = label_26(mask)
    return bool(labels[a]) and labels[a] == labels[b]


def distance_to_background(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each voxel to the nearest one outside the mask, axis by axis."""
    big = float(sum(s * s for s in mask.shape) + 1)
    squared = np.where(mask, big, 0.0)
    for axis in range(3):
        rows = np.ascontiguousarray(np.moveaxis(squared, axis, -1))
        lines, size = rows.reshape(-1, rows.shape[-1]), rows.shape[-1]
        best = lines.copy()
        # a voxel d steps away adds d * d; no step reaches further than the largest distance so far
        d = 1
        while d < size and d * d < best.max():
            np.minimum(best[:, d:], lines[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], lines[:, d:] + d * d, out=best[:, :-d])
            d += 1
        squared = np.moveaxis(best.reshape(rows.shape), -1, axis)
    return np.sqrt(squared)


def gaussian(page: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of a page, edges repeated."""
    r = max(1, int(3 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(page.astype(float), [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        page = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, padded)
    return page


def skeleton_degrees(points: DataFrame) -> DataFrame:
    """(z, y, x, neighbours) of skeleton voxels: how many of the 26 around each are there too. 1 is an end, 3 and more a branch."""
    steps = [s for s in np.ndindex(3, 3, 3) if s != (1, 1, 1)]
    step = F.explode(F.array(*[F.struct(*[F.lit(int(v) - 1).alias(f"d{c}") for v, c in zip(s, "zyx", strict=True)]) for s in steps]))
    around = points.select("z", "y", "x", step.alias("s")).select(*[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "zyx"])
    counts = around.groupBy("z", "y", "x").agg(F.count(F.lit(1)).alias("neighbours"))
    return points.select("z", "y", "x").distinct().join(counts, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def closest_on_triangles(p: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n triangles (n, 3, 3) its point closest to p (one point, or one for each triangle), and the distance: inside the plane, else on
    the nearest edge."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
    normal = np.cross(b - a, c - a)
    size = (normal * normal).sum(1)
    foot = p - ((p - a) * normal).sum(1)[:, None] / np.where(size > 0, size, 1)[:, None] * normal
    inside = size > 0
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, foot - u) * normal).sum(1) >= 0
    best, far = np.where(inside[:, None], foot, a), np.where(inside, np.linalg.norm(p - foot, axis=1), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        e = v - u
        length = (e * e).sum(1)
        t = np.clip(((p - u) * e).sum(1) / np.where(length > 0, length, 1), 0, 1)
        q = u + t[:, None] * e
        d = np.linalg.norm(p - q, axis=1)
        closer = d < far
        best, far = np.where(closer[:, None], q, best), np.where(closer, d, far)
    return best, far


def nearest_triangles(points: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """(point, triangle, distance): each point's closest triangle within the radius; the smaller number of equals.

    Triangles are copied to the grid cells that their boxes, widened by the radius, reach; points lie in one cell each."""
    boxes = triangles
    for c in "xyz":
        lo, hi = F.floor((F.least(*[f"{v}{c}" for v in "abc"]) - radius) / radius), F.floor((F.greatest(*[f"{v}{c}" for v in "abc"]) + radius) / radius)
        boxes = boxes.withColumn(f"cell_{c}", F.explode(F.sequence(lo, hi)))
    at = points.select("point", "x", "y", "z", *[F.floor(F.col(c) / radius).alias(f"cell_{c}") for c in "xyz"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"{v}{c}" for v in "abc" for c in "xyz"]
        for rows in batches:
            d = closest_on_triangles(rows[["x", "y", "z"]].to_numpy(float), rows[names].to_numpy(float).reshape(-1, 3, 3))[1]
            yield pd.DataFrame({"point": rows["point"], "triangle": rows["triangle"], "distance": d})

    pairs = at.join(boxes, ["cell_x", "cell_y", "cell_z"]).select("point", "x", "y", "z", "triangle", *[f"{v}{c}" for v in "abc" for c in "xyz"])
    close = pairs.mapInPandas(run, "point long, triangle long, distance double").filter(F.col("distance") <= radius)
    return close.groupBy("point").agg(F.min(F.struct("distance", "triangle")).alias("m")).select("point", "m.triangle", "m.distance")


def subdivided(triangles: np.ndarray, longest: float) -> np.ndarray:
    """Triangles cut at the middle of their longest edge until none is longer."""
    done, todo = [], triangles
    while len(todo):
        edges = np.linalg.norm(np.roll(todo, -1, axis=1) - todo, axis=2)
        k = edges.argmax(1)
        fine = edges.max(1) <= longest
        done.append(todo[fine])
        todo, k = todo[~fine], k[~fine]
        row = np.arange(len(todo))
        a, b, c = todo[row, k], todo[row, (k + 1) % 3], todo[row, (k + 2) % 3]
        m = (a + b) / 2
        todo = np.concatenate([np.stack([a, m, c], 1), np.stack([m, b, c], 1)])
    return np.concatenate(done) if done else triangles


def surface_voxels(triangles: DataFrame, pitch: float = 1.0) -> DataFrame:
    """(mesh, x, y, z): grid cells that the surface passes, by points at most half a cell apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"{v}{c}" for v in "abc" for c in "xyz"]
        for rows in batches:
            for mesh, own in rows.groupby("mesh"):
                fine = subdivided(own[names].to_numpy(float).reshape(-1, 3, 3), pitch / 2)
                points = np.concatenate([fine.reshape(-1, 3), fine.mean(1)])
                cells = np.unique(np.floor(points / pitch).astype("int64"), axis=0)
                yield pd.DataFrame({"mesh": mesh, "x": cells[:, 0], "y": cells[:, 1], "z": cells[:, 2]})

    return triangles.mapInPandas(run, "mesh string, x long, y long, z long").distinct()
