"""Bounded filters, lookups and column policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoundedFilter:
    """Value lists and inclusive ranges, all optional, joined by AND; a row with null or NaN fails each range that is given."""

    values: Mapping[str, Sequence] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    limit: int = 200

    MOST = 500

    def check(self, allowed_values: Sequence[str], allowed_ranges: Sequence[str], domains: Mapping[str, Sequence] | None = None) -> BoundedFilter:
        """Refuses unknown columns, empty or repeated value lists, values outside a domain, inverted ranges and limits out of bounds."""
        for name in [*self.values, *self.ranges]:
            if name not in (allowed_values if name in self.values else allowed_ranges):
                raise ValueError(f"unknown filter column: {name}")
        for name, values in self.values.items():
            if not values or len(set(values)) != len(values):
                raise ValueError(f"{name}: values must be given once each")
            if domains and name in domains and not set(values) <= set(domains[name]):
                raise ValueError(f"{name}: value outside its domain")
        for name, (low, high) in self.ranges.items():
            if low is not None and high is not None and low > high:
                raise ValueError(f"{name}: range is inverted")
        if not 1 <= self.limit <= self.MOST:
            raise ValueError(f"limit must be 1 to {self.MOST}")
        return self

    def condition(self) -> Column:
        parts = [F.col(c).isin(list(v)) for c, v in self.values.items()]
        for name, (low, high) in self.ranges.items():
            c = F.col(name)
            if low is not None:
                parts.append(c >= low)
            if high is not None:
                parts.append(c <= high)
            parts.append(~F.isnan(c.cast("double")))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def bounded(df: DataFrame, spec: BoundedFilter, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first `limit` matching rows in a total order, and the number of all matches as one row."""
    matching = df.filter(spec.condition())
    return matching.orderBy(*order).limit(spec.limit), matching.agg(F.count(F.lit(1)).alias("total_matches"))


def between_always(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Inclusive ranges that always apply: null and NaN rows go even where a range covers everything."""
    parts = [F.col(c).between(low, high) & ~F.isnan(F.col(c).cast("double")) for c, (low, high) in ranges.items()]
    return df.filter(reduce(lambda a, b: a & b, parts, F.lit(True)))


def point_lookup(df: DataFrame, key: str, value) -> dict:
    """Exactly one row; LookupError for none, ValueError for several."""
    rows = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if not rows:
        raise LookupError(f"no row with {key} = {value!r}")
    if len(rows) > 1:
        raise ValueError(f"several rows with {key} = {value!r}")
    return rows[0].asDict(recursive=True)


def allowed(name: str, names: Sequence[str], what: str = "column") -> str:
    if name not in names:
        raise ValueError(f"{what} {name!r} is not one of {', '.join(names)}")
    return name


def public_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the listed columns that there are, in the list's order."""
    return df.select(*[n for n in names if n in df.columns])


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def domain_violations(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, violations): values that are null, NaN, infinite or outside their range."""
    counts = []
    for name, (low, high) in ranges.items():
        c = F.col(name).cast("double")
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        if low is not None:
            bad = bad | (c < low)
        if high is not None:
            bad = bad | (c > high)
        counts.append(F.struct(F.lit(name).alias("column"), F.count_if(bad).alias("violations")))
    return df.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("x")).select("x.*")
