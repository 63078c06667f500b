"""Alignment of ordered records: global (order preserving) and by least-cost assignment.

Kernels are NumPy and run once per group of a cogroup, so groups (one file's commands before and
after, two adjacent conversations) spread over the cluster. Candidate pairs never leave the
kernel; only aligned pairs come out.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP = 0.1
THRESHOLD = 0.4


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a column of the matrix at a time.

    Columns are bit vectors of where a cell is one more (``up``) or less (``down``) than the one above it.
    """
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(diagonal | up)), up & diagonal
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        more, less = more << 1 | 1, less << 1
        vertical = same | down
        up = every & (less | ~(vertical | more))
        down = every & more & vertical
    return distance


def tanimoto(a: str, b: str) -> float:
    d = edit_distance(a, b)
    return 2 * d / (len(a) + len(b) + d) if a or b else 0.0


def cost_matrix(a: list[str], b: list[str], threshold: float | None = None) -> np.ndarray:
    """Normalised distances; cells that can't be below the threshold get it without being computed."""
    out = np.empty((len(a), len(b)))
    known: dict[tuple[str, str], float] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if threshold is not None and abs(len(x) - len(y)) * (2 - threshold) >= threshold * (len(x) + len(y)) and x != y:
                out[i, j] = threshold
                continue
            if (x, y) not in known:
                known[x, y] = tanimoto(x, y)
            out[i, j] = known[x, y] if threshold is None else min(known[x, y], threshold)
    return out


def align_ordered(cost: np.ndarray, skip: float = SKIP, mask: np.ndarray | None = None) -> list[tuple[int | None, int | None]]:
    """Global alignment at least cost: matches cost ``cost``, skips ``skip``; ties prefer a match, then skipping left.

    Pairs outside the mask cost max(4 * skip, 1).
    """
    n, m = cost.shape
    if mask is not None:
        if mask.shape != cost.shape:
            raise ValueError(f"a mask of shape {mask.shape} for costs of shape {cost.shape}")
        cost = np.where(mask, cost, max(4 * skip, 1.0))
    best = np.empty((n + 1, m + 1))
    best[0] = np.arange(m + 1) * skip
    ramp = np.arange(m + 1) * skip
    for i in range(1, n + 1):
        row = np.empty(m + 1)
        row[0] = i * skip
        row[1:] = np.minimum(best[i - 1, :-1] + cost[i - 1], best[i - 1, 1:] + skip)
        best[i] = np.minimum.accumulate(row - ramp) + ramp
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        here = best[i, j]
        if i and j and np.isclose(here, best[i - 1, j - 1] + cost[i - 1, j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and np.isclose(here, best[i - 1, j] + skip):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment by shortest augmenting paths; ties go to low rows, then low columns."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # column m is where a path starts
    for row in range(n):
        owner[m] = row
        at, least, came = m, np.full(m, np.inf), np.full(m, -1)
        seen = np.zeros(m + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            i = owner[at]
            free = ~seen[:m]
            reduced = c[i] - u[i] - v[:m]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], at
            choice = np.where(free, least, np.inf)
            nxt = int(choice.argmin())
            delta = choice[nxt]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[free] -= delta
            at = nxt
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def assign_below(a: list[str], b: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """Assignment of texts on clipped costs; only pairs strictly below the threshold come out."""
    if not a or not b:
        return []
    cost = cost_matrix(a, b, threshold)
    return [(i, j, float(cost[i, j])) for i, j in assign(cost) if cost[i, j] < threshold]


def cogrouped(left: DataFrame, right: DataFrame, by: list[str], order: str, text: str, kernel: Callable[[list[str], list[str]], list], inner: bool = True) -> DataFrame:
    """(by, a, b, cost): positions that a kernel aligns, per group; groups on one side only are dropped if ``inner``."""
    kinds = dict(left.dtypes)
    # names of their own keep Spark from mixing up the columns of two sides with one origin
    columns = [*by, order, text]
    left = left.select(*columns)
    right = right.select(*[F.col(c).alias(f"other_{c}") for c in columns])
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", a long, b long, cost double"

    kinds_out = {"a": "Int64", "b": "Int64", "cost": "float64"}

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.rename(columns={f"other_{c}": c for c in columns})
        some = x if len(x) else y
        none = pd.DataFrame({c: some[c].iloc[:0] for c in by} | {c: pd.Series([], dtype=t) for c, t in kinds_out.items()})
        if inner and (x.empty or y.empty):
            return none
        x, y = x.sort_values(order, kind="stable"), y.sort_values(order, kind="stable")
        rows = kernel(x[text].fillna("").tolist(), y[text].fillna("").tolist())
        if not rows:
            return none
        out = pd.DataFrame(rows, columns=["a", "b", "cost"]).astype(kinds_out)
        for k, c in enumerate(by):
            out.insert(k, c, some[c].iloc[0])
        return out

    return left.groupBy(*by).cogroup(right.groupBy(*[f"other_{c}" for c in by])).applyInPandas(run, schema)


def ordered_kernel(skip: float = SKIP) -> Callable:
    def kernel(a: list[str], b: list[str]) -> list:
        cost = cost_matrix(a, b)
        return [(i, j, float(cost[i, j]) if i is not None and j is not None else None) for i, j in align_ordered(cost, skip)]

    return kernel


def align_by_assignment(left: DataFrame, right: DataFrame, by: list[str], order: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    return cogrouped(left, right, by, order, text, lambda a, b: assign_below(a, b, threshold))


def align_by_order(left: DataFrame, right: DataFrame, by: list[str], order: str, text: str, skip: float = SKIP) -> DataFrame:
    return cogrouped(left, right, by, order, text, ordered_kernel(skip))


def align_with_diff(a: list[str], b: list[str], a_hit: list[bool], b_hit: list[bool], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Alignment that only assigns what a textual diff touches; the rest pairs up in order.

    Counts that differ outside the diff are an error.
    """
    a_rest = [i for i, h in enumerate(a_hit) if not h]
    b_rest = [j for j, h in enumerate(b_hit) if not h]
    if len(a_rest) != len(b_rest):
        raise ValueError("unchanged records differ in number: the diff doesn't belong to these snapshots")
    a_in, b_in = [i for i, h in enumerate(a_hit) if h], [j for j, h in enumerate(b_hit) if h]
    changed = assign_below([a[i] for i in a_in], [b[j] for j in b_in], threshold)
    return sorted([*zip(a_rest, b_rest, strict=True), *((a_in[i], b_in[j]) for i, j, _ in changed)])


def check_alignment(pairs: list[tuple[int, int]], n: int, m: int) -> None:
    """Indices must be in range and come up once."""
    if any(not (0 <= i < n and 0 <= j < m) for i, j in pairs):
        raise IndexError("an aligned index is out of range")
    if len({i for i, _ in pairs}) != len(pairs) or len({j for _, j in pairs}) != len(pairs):
        raise ValueError("an index is aligned twice")
