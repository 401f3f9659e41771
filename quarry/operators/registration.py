"""Fits of one point set to another: sums are made by Spark, the small systems are solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, both means, the cross covariance (b by a) and the covariance of a; rows with a null or NaN are left out."""
    real = df.select(*[F.col(c).cast("double").alias(c) for c in [*a, *b]]).dropna()
    means = real.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in [*a, *b]]).first()
    if not means["n"]:
        raise ValueError("no points to fit")
    ma, mb = (np.array([means[c] for c in cols]) for cols in (a, b))
    centred = {c: F.col(c) - F.lit(float(m)) for cols, mean in ((a, ma), (b, mb)) for c, m in zip(cols, mean, strict=True)}
    cross = [F.avg(centred[y] * centred[x]) for y in b for x in a]
    own = [F.avg(centred[x] * centred[y]) for x in a for y in a]
    row = real.agg(*cross, *own).first()
    k = len(cross)
    return means["n"], ma, mb, np.array(row[:k]).reshape(len(b), len(a)), np.array(row[k:]).reshape(len(a), len(a))


def affine_fit(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The 4 x 4 matrix that maps a to b with least squared error."""
    _, ma, mb, cross, own = _moments(df, a, b)
    if np.linalg.matrix_rank(own) < len(a):
        raise ValueError("the points do not span the space")
    linear = np.linalg.solve(own, cross.T).T
    out = np.eye(len(a) + 1)
    out[:-1, :-1], out[:-1, -1] = linear, mb - linear @ ma
    return out


def similarity_fit(df: DataFrame, a: Sequence[str], b: Sequence[str], scaled: bool = True) -> dict:
    """Rotation (a proper one), scale and shift that map a to b with least squared error, with the residual."""
    n, ma, mb, cross, own = _moments(df, a, b)
    u, s, vt = np.linalg.svd(cross)
    if np.sum(s > 1e-12 * max(s[0], 1e-300)) < len(a) - 1:
        raise ValueError("the points do not fix a rotation")
    sign = np.ones(len(s))
    sign[-1] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    rotation = u @ np.diag(sign) @ vt
    scale = float((s * sign).sum() / np.trace(own)) if scaled else 1.0
    matrix = np.eye(len(a) + 1)
    matrix[:-1, :-1], matrix[:-1, -1] = scale * rotation, mb - scale * rotation @ ma
    return {"matrix": matrix, "rotation": rotation, "scale": scale, "n": n}


def residuals(df: DataFrame, a: Sequence[str], b: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """One row: rms, median, 90th percentile and largest distance between the mapped and the given points."""
    from quarry.operators.geometry import transformed

    there = transformed([F.col(c).cast("double") for c in a], matrix.tolist())
    d = F.sqrt(sum((F.pow(x - F.col(c), 2) for x, c in zip(there, b, strict=True)), F.lit(0.0)))
    return df.agg(F.sqrt(F.avg(d * d)).alias("rms"), F.percentile(d, 0.5).alias("median"), F.percentile(d, 0.9).alias("p90"), F.max(d).alias("max"))


def proper_cube_rotations() -> list[np.ndarray]:
    """The 24 rotations that map a cube to itself."""
    out = []
    for order in permutations(range(3)):
        for signs in product((1, -1), repeat=3):
            m = np.zeros((3, 3), int)
            for row, (axis, sign) in enumerate(zip(order, signs, strict=True)):
                m[row, axis] = sign
            if round(np.linalg.det(m)) == 1:
                out.append(m)
    return out


def compose(*matrices: np.ndarray) -> np.ndarray:
    """One transform that applies the given ones from left to right."""
    out = np.eye(4)
    for m in matrices:
        out = np.asarray(m, float) @ out
    return out


def invert(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.asarray(matrix, float))
