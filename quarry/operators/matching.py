"""Least-cost matching of positives to controls within strata."""

from __future__ import annotations

import hashlib
import heapq
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def assignment(cost: np.ndarray) -> list[int]:
    """For each row (no more rows than columns) its column, so that the total cost is least; shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        of[0], column = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[column]:
            used[column] = True
            free = ~used
            free[0] = False
            reduced = cost[of[column] - 1] - u[of[column]] - v[1:]
            better = np.zeros(m + 1, bool)
            better[1:] = free[1:] & (reduced < least[1:])
            least[better], way[better] = reduced[better[1:]], column
            open_columns = np.flatnonzero(free)
            step_to = open_columns[np.argmin(least[open_columns])]
            delta = least[step_to]
            u[of[used]] += delta
            v[used] -= delta
            least[free] -= delta
            column = step_to
        while column:
            of[column], column = of[way[column]], way[column]
    out = [0] * n
    for column in range(1, m + 1):
        if of[column]:
            out[of[column] - 1] = column - 1
    return out


#: How many of its cheapest columns a row is given at first, how many times more when they do not do, and entries of such lists kept in all.
FIRST, MORE, HELD = 128, 4, 8_000_000


def sparse_assignment(places: Sequence[int], rows: int, columns: int, cheapest: Callable[[int, int], tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each column's row or -1, rows' duals, columns' duals): a column of its own for each place (a row, which may come again), at the least total.

    cheapest(row, k) gives columns, costs (none negative) and a bound: at least k columns, and every other one costs more than the bound. Shortest
    augmenting paths over these lists; a list is lengthened as soon as a column outside it could lie on the shortest path, so the result is that
    of the whole matrix, which is never held. Columns' duals are at most 0, so what a list leaves out is at least as far as its bound says."""
    if len(places) > columns:
        raise ValueError("more places than columns")
    u, v, of = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    width = np.full(rows, FIRST)
    lists: OrderedDict[int, tuple[np.ndarray, np.ndarray, float]] = OrderedDict()
    held = 0

    def listed(row: int, longer: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        nonlocal held
        if longer:
            width[row] *= MORE
            if row in lists:
                held -= len(lists.pop(row)[0])
        if row in lists:
            lists.move_to_end(row)
            return lists[row]
        got = lists[row] = cheapest(row, int(width[row]))
        held += len(got[0])
        while held > HELD and len(lists) > 1:
            held -= len(lists.popitem(last=False)[1][0])
        return got

    # of the columns that a search has reached: which, how far (once settled: less, and in the second more, than any), and from which row; `at` leads back
    at = np.full(columns, -1)
    reached, far, ahead, via = np.empty(64, int), np.empty(64), np.empty(64), np.empty(64, int)
    for source in places:
        size, depth, came, limits, settled = 0, {source: 0.0}, {source: -1}, [], []
        row, longer = source, False
        while True:
            if row >= 0:
                ids, cost, bound = listed(row, longer)
                near = cost - v[ids] + (depth[row] - u[row])
                place = at[ids]
                new = place < 0
                if size:
                    better = (near < far[place]).nonzero()[0]
                    better = better[~new[better]]
                    if len(better):
                        seen = place[better]
                        far[seen] = ahead[seen] = near[better]
                        via[seen] = row
                end = size + np.count_nonzero(new)
                if end > size:
                    if end > len(reached):
                        reached, far, ahead, via = (np.resize(a, 2 * end) for a in (reached, far, ahead, via))
                    ids = ids[new]
                    at[ids] = np.arange(size, end)
                    reached[size:end], via[size:end] = ids, row
                    far[size:end] = ahead[size:end] = near[new]
                    size = end
                heapq.heappush(limits, (depth[row] + bound - u[row], row))
            next_at = int(ahead[:size].argmin())
            if limits[0][0] < ahead[next_at]:
                row, longer = heapq.heappop(limits)[1], True
                continue
            column, least = int(reached[next_at]), float(ahead[next_at])
            settled.append((column, least))
            far[next_at], ahead[next_at] = -np.inf, np.inf
            row, longer = int(of[column]), False
            if row < 0:
                break
            if row in depth:
                row = -1
            else:
                depth[row], came[row] = least, column
        for c, d in settled:
            v[c] = min(v[c] + d - least, 0)
        for r, d in depth.items():
            u[r] += least - d
        while column >= 0:
            row = int(via[at[column]])
            of[column], column = row, came[row]
        at[reached[:size]] = -1
    return of, u, v


#: The cost of a pair that must not be.
BANNED = 1e9
#: Weight of a difference in quality against a squared distance, and of the two ties: by place, and by a digest of the pair.
QUALITY, BY_PLACE, BY_PAIR = 0.1, 1e-9, 1e-12


def pair_fraction(positive: int, control: int) -> float:
    """A number in [0, 1) that depends on the pair alone."""
    return int.from_bytes(hashlib.sha256(f"{positive}:{control}".encode()).digest()[:8], "big") / float(1 << 64)


def match_controls(df: DataFrame, stratum: str, key: str, positive: str, x: list[str], per_positive: int = 2, quality: str | None = None, nodes: str | None = None) -> DataFrame:
    """(stratum, positive, control, slot, cost): each positive's controls within its stratum, at the least total cost.

    Cost: squared distance, QUALITY times the difference in quality (if named), and two ties too small to matter otherwise. nodes: an array
    column; a control that shares a node with a positive is never its control, nor is one whose cost is no finite number. Slots number a positive's
    controls by key. A stratum is one task that holds its rows and each positive's cheapest controls, never all pairs. Where controls run short,
    positives go without in order of key."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        yes, no = rows[rows[positive]], rows[~rows[positive].astype(bool)]
        places = [k for _ in range(per_positive) for k in range(len(yes))][: len(no)]
        made = []
        if places:
            yes_key, no_key, yes_x, no_x = yes[key].tolist(), no[key].tolist(), yes[x].to_numpy(float), [no[c].to_numpy(float) for c in x]
            if quality:
                yes_quality, no_quality = yes[quality].to_numpy(float), no[quality].to_numpy(float)
            if nodes:
                yes_nodes, holders = yes[nodes].tolist(), {}
                for c, held in enumerate(no[nodes]):
                    for node in held:
                        holders.setdefault(node, []).append(c)
            by_place = BY_PLACE * (np.arange(len(no)) + 1) / (len(no) + 1)
            first = no_x[0] if x else np.zeros(len(no))
            everyone, by_first = np.arange(len(no)), np.argsort(first, kind="stable")
            first = first[by_first]

            def costs(k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """A positive's costs without ties, and which of the controls it must not have."""
                cost = np.zeros(len(ids))
                for own, others in zip(yes_x[k], no_x, strict=True):
                    cost += (own - others[ids]) ** 2
                if quality:
                    cost = cost + QUALITY * np.abs(yes_quality[k] - no_quality[ids])
                banned = ~np.isfinite(cost)
                if nodes:
                    banned |= np.isin(ids, [c for node in yes_nodes[k] for c in holders.get(node, [])])
                return cost, banned

            def bound_of(k: int, ids: np.ndarray, width: int) -> float:
                """At least `width` of these controls cost no more, whatever their own ties."""
                cost, banned = costs(k, ids)
                return np.partition(np.where(banned, BANNED, cost + (by_place[ids] + BY_PAIR)), width - 1)[width - 1]

            def cheapest(k: int, width: int) -> tuple[np.ndarray, np.ndarray, float]:
                """The neighbours by the first number bound the cost, and so how far the others can lie by it; digests are taken only of pairs that cost
                no more than the bound without them."""
                ids, bound = everyone, np.inf
                if width < len(no):
                    own = yes_x[k][0] if x else 0.0
                    at = np.searchsorted(first, own)
                    bound = bound_of(k, by_first[max(at - width, 0) : at + width], width)
                    if bound < BANNED:
                        reach = np.sqrt(bound) * (1 + 1e-9) + 4 * np.spacing(abs(own))
                        ids = np.sort(by_first[np.searchsorted(first, own - reach) : np.searchsorted(first, own + reach, "right")])
                    bound = bound_of(k, ids, width)
                cost, banned = costs(k, ids)
                near = (np.where(banned, BANNED, cost + by_place[ids]) <= bound).nonzero()[0]
                ids, cost, banned = ids[near], cost[near], banned[near]
                tie = np.array([0.0 if never else pair_fraction(yes_key[k], no_key[c]) for c, never in zip(ids.tolist(), banned.tolist(), strict=True)])
                return ids, np.where(banned, BANNED, cost + (by_place[ids] + BY_PAIR * tie)), bound

            of = sparse_assignment(places, len(yes), len(no), cheapest)[0]
            taken: dict[int, list[int]] = {}
            for c in (of >= 0).nonzero()[0].tolist():
                taken.setdefault(int(of[c]), []).append(c)
            found = []
            for k, own in taken.items():
                found += [(int(yes_key[k]), int(no_key[c]), float(cost)) for c, cost, never in zip(own, *costs(k, np.array(own)), strict=True) if not never]
            slot: dict[int, int] = {}
            for p, c, value in sorted(found):
                made.append((rows[stratum].iloc[0], p, c, slot.setdefault(p, 0), value))
                slot[p] += 1
        return pd.DataFrame(made, columns=["stratum", "positive", "control", "slot", "cost"])

    kind = df.schema[stratum].dataType.simpleString()
    columns = [stratum, key, positive, *x, *[c for c in (quality, nodes) if c]]
    # few bytes make much work here, so that adaptive execution, which joins tasks by bytes, must not put many strata into one
    spread = df.select(*columns).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stratum)
    return spread.groupBy(stratum).applyInPandas(solve, f"stratum {kind}, positive long, control long, slot int, cost double")
