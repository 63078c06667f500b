"""Queries that take in all of their input, against brute force on small fixtures."""

from __future__ import annotations

import random
from collections import defaultdict
from functools import lru_cache
from itertools import permutations

import pytest

import __spark_entry__ as entry
from tessella.plans import catalog

CONVERSATIONS = "conv_id long, turn int, text string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tanimoto(a, b):
    d = levenshtein(a, b)
    return 2 * d / (len(a) + len(b) + d) if a or b else 0.0


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_adjacent_distance(spark, tmp_path):
    same = "word " * 60  # longer than any excerpt
    texts = [same + "one end", same + "another", "schön – 日本語 😀", "schon - 日本 😀!", "", None, "last"]
    d = table(spark, tmp_path, "conversations", [(1, i, x) for i, x in enumerate(texts)], CONVERSATIONS)
    got = {r.turn: (r.distance, r.tanimoto) for r in entry.queries()["adjacent_distance"](spark, d).collect()}
    want = {}
    for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        known = a is not None and b is not None
        want[i] = (levenshtein(a, b), pytest.approx(tanimoto(a, b), abs=1e-9)) if known else (None, None)
    assert got == want
    assert {r.turn: (r.distance, r.tanimoto) for r in catalog.flagship(spark, d).collect()} == want


def revised(rows):
    """What domain._conversation_pairs makes of turns."""
    return [(c, t, x[: max(len(x) - 6, 0)]) for c, t, x in rows if (c + t) % 5 != 0]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    rng = random.Random(5)
    same = "an opening that many of the turns share, " * 5  # 205 characters
    rows = []
    for c in range(6):
        for t in range(5):
            tail = "".join(rng.choice("abcdé日 ") for _ in range(rng.randint(0, 250)))
            rows.append((c, t, (same if rng.random() < 0.7 else "") + tail))
    rows += [(9, 0, ""), (9, 2, "short"), (9, 3, same)]
    return table(spark, tmp_path_factory.mktemp("turns"), "conversations", rows, CONVERSATIONS), rows


def sides(rows):
    for c in sorted({r[0] for r in rows}):
        yield c, [x for k, _, x in rows if k == c], [x for k, _, x in revised(rows) if k == c]


def test_assign_min_cost(spark, turns):
    d, rows = turns
    got = defaultdict(dict)
    for r in entry.queries()["assign_min_cost"](spark, d).collect():
        got[r.conv_id][r.a, r.b] = r.cost
    for c, a, b in sides(rows):
        assert len(b) <= len(a)
        cost = [[min(tanimoto(x, y), 0.4) for y in b] for x in a]
        best = min(sum(cost[i][j] for j, i in enumerate(p)) for p in permutations(range(len(a)), len(b)))
        pairs = got[c]
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert pairs == {(i, j): pytest.approx(cost[i][j]) for i, j in pairs} and all(cost[i][j] < 0.4 for i, j in pairs)
        assert sum(pairs.values()) + 0.4 * (len(b) - len(pairs)) == pytest.approx(best)


def test_nw_align(spark, turns):
    d, rows = turns
    got = defaultdict(list)
    for r in entry.queries()["nw_align"](spark, d).collect():
        got[r.conv_id].append((r.a, r.b, r.cost))
    for c, a, b in sides(rows):
        cost = [[tanimoto(x, y) for y in b] for x in a]

        @lru_cache(None)
        def best(i, j, cost=cost, n=len(a), m=len(b)):
            ways = [0.0] if i == n and j == m else []
            ways += [0.1 + best(i + 1, j)] if i < n else []
            ways += [0.1 + best(i, j + 1)] if j < m else []
            ways += [cost[i][j] + best(i + 1, j + 1)] if i < n and j < m else []
            return min(ways)

        pairs = got[c]
        assert sorted(i for i, _, _ in pairs if i is not None) == list(range(len(a)))
        assert sorted(j for _, j, _ in pairs if j is not None) == list(range(len(b)))
        both = [(i, j, x) for i, j, x in pairs if i is not None and j is not None]
        assert sorted(both) == sorted(both, key=lambda p: p[1])  # in order
        assert all(x == pytest.approx(cost[i][j]) for i, j, x in both)
        assert sum(x for _, _, x in both) + 0.1 * (len(pairs) - len(both)) == pytest.approx(best(0, 0))


def test_lineitem_components(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(60), float(rng.randint(1, 50)), rng.randint(0, 10) / 100) for _ in range(45)]
    rows += [(100, p, 1.0, 0.0) for p in range(200, 500)]  # a hot supplier
    schema = "l_suppkey long, l_partkey long, l_quantity double, l_discount double"
    d = table(spark, tmp_path, "lineitem", rows, schema)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, p, _, _ in rows:
        x, y = sorted((root(f"s{s}"), root(f"p{p}")))
        parent[y] = x
    got = {r.node: r.component for r in entry.queries()["lineitem_components"](spark, d).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert len(set(got.values())) > 3
