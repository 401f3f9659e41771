"""Matching within large strata, against the whole matrix."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quarry.operators import matching


class Stratum:
    """Stands in for a DataFrame, so that what a task runs can be run here."""

    schema = {"stratum": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "int"))}

    sparkSession = SimpleNamespace(conf={"spark.sql.shuffle.partitions": "1"})

    def select(self, *columns):
        return self

    repartition = groupBy = select

    def applyInPandas(self, f, schema):
        return f


def stratum(positives, controls):
    x = np.concatenate([positives, controls])
    return pd.DataFrame({"stratum": 1, "id": np.arange(len(x)), "pos": np.arange(len(x)) < len(positives), "x": x})


def test_large_stratum_is_matched_without_its_matrix():
    """600 x 6000 pairs are 29 MB as numbers alone; a tenth of them lie on equal places, as in tables of copies."""
    rng = np.random.default_rng(4)
    yes, no = rng.uniform(0, 1e4, 600), rng.uniform(0, 1e4, 6000)
    yes[:60], no[:600] = yes[0], yes[0] + 5
    rows = stratum(yes, no)
    solve = matching.match_controls(Stratum(), "stratum", "id", "pos", ["x"])
    tracemalloc.start()
    got = solve(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6
    assert got.groupby("positive").size().eq(2).all() and got.positive.nunique() == 600 and got.control.is_unique
    cost = (yes[:, None] - no[None]) ** 2
    best = matching.assignment(np.concatenate([cost, cost]))
    assert got.cost.sum() == pytest.approx(sum(cost[k % 600, c] for k, c in enumerate(best)))


@pytest.mark.parametrize("held", [8_000_000, 40])
def test_lists_give_what_the_matrix_gives(monkeypatch, held):
    """Short lists that are lengthened and thrown away, equal costs, pairs that must not be, and controls that run short; no pair costs less than its duals."""
    monkeypatch.setattr(matching, "FIRST", 2)
    monkeypatch.setattr(matching, "HELD", held)
    rng = np.random.default_rng(1)
    for t in range(300):
        n, m, per = (int(rng.integers(1, k)) for k in (9, 20, 4))
        cost = rng.random((n, m)) * 1e4 if t % 2 else rng.integers(0, 5, (n, m)).astype(float)
        cost[rng.random((n, m)) < 0.2 * (t % 3)] = matching.BANNED
        places = [k for _ in range(per) for k in range(n)][:m]

        def cheapest(k, width, cost=cost):
            bound = np.sort(cost[k])[width - 1] if width < cost.shape[1] else np.inf
            ids = np.flatnonzero(cost[k] <= bound)
            return ids, cost[k][ids], bound

        of, u, v = matching.sparse_assignment(places, n, m, cheapest)
        assert np.array_equal(np.bincount(of[of >= 0], minlength=n), np.bincount(places, minlength=n))
        best = sum(cost[k, c] for k, c in zip(places, matching.assignment(cost[places]), strict=True))
        assert sum(cost[k, c] for c, k in enumerate(of) if k >= 0) == pytest.approx(best)
        assert (v <= 0).all() and (cost - u[:, None] - v >= -1e-5).all()


def test_windows_over_several_numbers(monkeypatch):
    """Lists from neighbours by the first number are the cheapest by all of them; a control without a number is nobody's."""
    monkeypatch.setattr(matching, "FIRST", 3)
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"stratum": 1, "id": np.arange(90), "pos": np.arange(90) % 4 == 0, "x": rng.integers(0, 9, 90) * 1.0, "y": rng.integers(0, 9, 90) * 1.0, "q": rng.random(90)})
    rows["nodes"] = [[i % 7, 10 + i % 5] for i in rows.id]
    rows.loc[[5, 8], "x"] = np.nan
    got = matching.match_controls(Stratum(), "stratum", "id", "pos", ["x", "y"], 2, "q", "nodes")(rows)
    yes, no = rows[rows.pos], rows[~rows.pos]
    cost = (yes.x.to_numpy()[:, None] - no.x.to_numpy()) ** 2 + (yes.y.to_numpy()[:, None] - no.y.to_numpy()) ** 2 + 0.1 * np.abs(yes.q.to_numpy()[:, None] - no.q.to_numpy())
    shared = np.array([[bool(set(a) & set(b)) for b in no.nodes] for a in yes.nodes])
    cost = np.where(shared | np.isnan(cost), matching.BANNED, cost)
    best = matching.assignment(np.concatenate([cost, cost]))
    want = [cost[k % len(yes), c] for k, c in enumerate(best)]
    kept = [w for w in want if w < matching.BANNED]
    assert len(got) == len(kept) > 40 and got.cost.sum() == pytest.approx(sum(kept))
    assert not {5, 8} & ({*got.positive} | {*got.control})
