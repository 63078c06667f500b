"""Suffix-array dedup, DartMinHash and cap filters against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import capfilter, components, dartminhash, suffixlevels
from tessella.llm.shared import lookup
from tessella.sources.tables import load


def groups_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


def covered(rows, match=200):
    where = defaultdict(list)
    data = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, b) in enumerate(data):
        for p in range(len(b) - match + 1):
            where[b[p : p + match]].append((k, p))
    marks = [bytearray(len(b)) for _, b in data]
    for found in where.values():
        if len(found) > 1:
            for k, p in found:
                marks[k][p : p + match] = b"\1" * match
    return data, marks


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared, rows = [text(rng.randint(20, 120)) for _ in range(10)], []
    for i in range(110):
        r = rng.random()
        if r < 0.3:
            t = text(rng.randint(0, 200))
        elif r < 0.55:
            t = text(rng.randint(0, 60)) + rng.choice(shared) + text(rng.randint(0, 60))
        elif r < 0.7 and rows:
            t = rows[rng.randrange(len(rows))][1]
        elif r < 0.8 and rows:
            t = list(rows[rng.randrange(len(rows))][1] or "x")
            for _ in range(3):
                t[rng.randrange(len(t)) : 0] = "Z"
            t = "".join(t)
        elif r < 0.9:
            t = rng.choice(words) * rng.randint(1, 300)
        elif r < 0.93:
            t = None
        else:
            t = (rng.choice(words) + " ") * rng.randint(30, 90) + text(50)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed, size, chunk", [(1, 8 << 20, 1 << 20), (2, 3000, 1 << 20), (3, 20_000, 1 << 20)])
def test_suffix_levels(spark, seed, size, chunk):
    rows = passages(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixlevels.repeated_bytes(df, batch_bytes=size).collect()}
    want, texts = {}, {}
    for (i, b), m in zip(*covered(rows), strict=True):
        left = bytes(x for x, y in zip(b, m, strict=True) if not y)
        runs = sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
        want[i] = (len(b), sum(m), runs, hashlib.sha256(left).hexdigest())
        texts[i] = left.decode("utf-8", "ignore")
    assert got == want
    kept = suffixlevels.remove_repeats(df, batch_bytes=size)
    assert kept.columns == df.columns
    original = dict(rows)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: None if original[i] is None else t for i, t in texts.items()}


@pytest.mark.parametrize("bits", [1, 9])
def test_suffix_fingerprints_are_only_candidates(spark, bits):
    """Windows that share a fingerprint without being equal stay, and equal ones among them go."""
    rows = passages(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixlevels.repeated_bytes(df, batch_bytes=6000, bits=bits).collect()}
    want = {}
    for (i, b), m in zip(*covered(rows), strict=True):
        want[i] = (sum(m), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest())
    assert got == want


def test_suffix_long(spark):
    """A text longer than a batch, and a passage that lies deep in it."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 50 + long[400_000:400_300] + "y" * 50), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixlevels.repeated_bytes(df, batch_bytes=10_000).collect()}
    assert got == {1: (600_000, 300, 1), 2: (400, 300, 1), 3: (0, 0, 0)}


def test_anchors_across_chunks(monkeypatch):
    """Chunking a buffer changes nothing."""
    import pyarrow as pa

    rows = pa.chunked_array([[t for _, t in passages(5)]], pa.string())
    whole = suffixlevels.Anchors(suffixlevels.Buffer(rows), 200, 100)
    monkeypatch.setattr(suffixlevels, "CHUNK", 777)
    parts = suffixlevels.Anchors(suffixlevels.Buffer(rows), 200, 100)
    for name in ("place", "left", "right", "rep", "context", "head", "several"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_level_family():
    rng = np.random.default_rng(1)
    family, everything = suffixlevels.LevelFamily(), []
    for _ in range(40):
        keys = np.sort(rng.integers(0, 3000, rng.integers(1, 60)).astype(np.uint64))
        family.add(keys)
        everything.append(keys)
    seen, owner = family.result()
    keys = np.concatenate(everything)
    counts = Counter(keys.tolist())
    assert seen.tolist() == [counts[k] > 1 for k in keys.tolist()]
    first = {}
    for i, k in enumerate(keys.tolist()):
        first.setdefault(k, i)
    assert sorted(np.flatnonzero(owner).tolist()) == sorted(first.values())
    assert len(family.levels) <= 12


def test_suffix_edges(spark):
    df = spark.createDataFrame([(None, "x" * 500), (1, None), (1, None), (2, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffixlevels.repeated_bytes(df).collect())
    assert got == [("1", 0, 0, 0), ("1", 0, 0, 0), ("2", 0, 0, 0), ("None", 500, 500, 1)]
    assert suffixlevels.repeated_bytes(df.limit(0)).count() == 0
    assert suffixlevels.remove_repeats(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_documents(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def edited(t, k):
        w = t.split()
        for _ in range(k):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    base, hot, rows = [text(rng.randint(1, 200)) for _ in range(20)], text(150), []
    for i in range(260):
        r = rng.random()
        if r < 0.25:
            t = text(rng.randint(0, 150))
        elif r < 0.5:
            t = edited(rng.choice(base), rng.randint(0, 6))
        elif r < 0.85:
            t = edited(hot, rng.randint(0, 6))  # similarities around 0.8: chains of links
        elif r < 0.9:
            t = hot.upper()
        elif r < 0.93:
            t = None
        else:
            t = (rng.choice(words) + " ") * rng.randint(1, 40)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed, rounds, block", [(5, 3, 2048), (6, 1, 16)])
def test_near_duplicates(spark, monkeypatch, seed, rounds, block):
    monkeypatch.setattr(dartminhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(dartminhash, "BLOCK", block)
    rows = near_documents(seed)
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()) - 1e-12
    ]
    want = groups_of(len(rows), links)
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, kept string, uid int").repartition(3)
    got = {r.doc_id: r for r in dartminhash.near_duplicates(df, batch_bytes=30_000).collect()}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(got[i].group_size == want.count(want[i]) for i in got)
    if rounds == 3:
        stay = dartminhash.drop_near_copies(df, batch_bytes=30_000)
        assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    errors = []
    for _ in range(30):
        a = [rng.choice(words) for _ in range(rng.randint(20, 400))]
        b = a[: rng.randint(1, len(a))] + [rng.choice(words) for _ in range(rng.randint(0, 50))]
        cell, bounds = dartminhash.cells([" ".join(a).encode(), " ".join(b).encode()])
        sig = dartminhash.signatures(cell, bounds, 512)
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        true = sum((x & y).values()) / sum((x | y).values())
        assert dartminhash.similarity(np.sort(cell[: bounds[1]]), np.sort(cell[bounds[1] :])) == pytest.approx(true)
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.1


def test_near_duplicate_edges(spark):
    same = "one two three four five six"
    rows = [(None, same), (1, same.upper()), (1, same.upper()), (2, None), (3, ""), (4, " \n"), (5, "single"), (6, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.group_size, r.kept) for r in dartminhash.near_duplicates(df).collect())
    assert [g[:3] for g in got] == [("1", "1", 3), ("1", "1", 3), ("2", "2", 1), ("3", "3", 1), ("4", "4", 1), ("5", "5", 2), ("6", "5", 2), ("None", "1", 3)]
    assert sum(g[3] for g in got) == 5
    assert dartminhash.drop_near_copies(df).count() == 5
    assert dartminhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_leader_too_long(spark, monkeypatch, rounds):
    """Buckets whose leader fits none of its members are still compared."""
    monkeypatch.setattr(dartminhash, "STAR_ROUNDS", rounds)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:98], "x", "y"]), " ".join([*words, *(f"v{i}" for i in range(40))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    search = dartminhash._Search(df, "doc_id", "text", 0.8, 1 << 20)
    search.rows = search.rows.withColumn("bands", F.array(F.lit(1).cast("long")))  # one bucket, led by the last text
    uid = {r.id: r.uid for r in search.rows.collect()}
    assert uid[2] == max(uid.values())
    assert {frozenset((r.a, r.b)) for r in search.links().collect()} == {frozenset((uid[0], uid[1]))}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 30), (200, 260)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2)] + [(7, 7)]
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = groups_of(n, links)
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert got == {i: want[i] for i in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup(spark):
    left = spark.createDataFrame([("a", i, None) for i in range(3000)] + [(str(i), i, None) for i in range(50)] + [(None, 1, None)], "key string, x long, hot int")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").filter("key is not null and key <> '7'")
    got = lookup(left, right, ["key"], "n", left["x"])
    assert got.columns == ["key", "x", "hot", "n"] and got.count() == left.count()
    assert {(r.key, r.n) for r in got.collect()} == {("a", 3000), (None, None), ("7", None)} | {(str(i), 1) for i in range(50) if i != 7}


def linked_vectors(rows, least=0.93):
    units = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    by = defaultdict(list)
    for k, (_, _, label) in enumerate(rows):
        if units[k] is not None:
            by[label].append(k)
    links = []
    for some in by.values():
        x = np.array([units[k] for k in some])
        links += [(some[i], some[j]) for i, j in np.argwhere(x @ x.T >= least) if i > j]
    degree = Counter(k for pair in links for k in pair)
    root = groups_of(len(rows), links)
    least_id = defaultdict(lambda: 1 << 62)
    for k, r in enumerate(rows):
        least_id[root[k]] = min(least_id[root[k]], r[0])
    return {r[0]: (degree[k], least_id[root[k]]) for k, r in enumerate(rows)}, len(links)


@pytest.mark.parametrize("block", [2048, 20])
def test_cap_filters(spark, block):
    table = load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(4)
    x = rows[3][1]
    rows += [(10**6 + i, x, rows[3][2]) for i in range(60)]
    rows += [(2 * 10**6 + i, v, 1) for i, v in enumerate([None, [0.0] * 64, [float("nan")] * 64, [1.0, None] * 32, [], [1.0] * 3, [float("inf")] * 64])]
    rows += [(3 * 10**6, x, None), (3 * 10**6 + 1, [v * 3 for v in x], rows[3][2])]
    for i in range(300):  # pairs on both sides of the threshold
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        z = rng.standard_normal(64)
        z -= z @ a * a
        t = rng.uniform(0.90, 0.96)
        b = t * a + np.sqrt(1 - t * t) * z / np.linalg.norm(z)
        rows += [(4 * 10**6 + 2 * i, a.astype(np.float32).tolist(), 3), (4 * 10**6 + 2 * i + 1, b.astype(np.float32).tolist(), 3)]
    want, n = linked_vectors(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.near_vectors(df, block=block).collect()}
    assert set(got) == set(want)
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    assert found >= 0.999 * 2 * n  # recall
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want)


def test_cap_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert capfilter.near_vectors(empty).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [-0.0, 1.0], 1), (5, [0.0, 1.0], 1), (6, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in capfilter.near_vectors(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("4", 1, "4"), ("5", 1, "4"), ("6", 0, "6"), ("None", 2, "1")]


def test_cap_lengths(spark):
    """Vectors of a rarer length link with each other, and not with those of other lengths."""
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, [1.0, float(i)], 1) for i in (0, 5, 50, 51)] + [(10, a, 1), (11, a, 1), (12, b, 1), (13, c, 1), (14, a, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.near_vectors(df).collect()}
    assert got == {0: (0, 0), 5: (2, 5), 50: (2, 5), 51: (2, 5), 10: (2, 10), 11: (2, 10), 12: (2, 10), 13: (0, 13), 14: (0, 14)}


def test_many_links_settle(spark):
    """The state of 2**25 links and more doesn't overflow (a sum of 40-bit marks did from 2**24 on)."""
    links = spark.range(1 << 25).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    n, *marks = components._state(links)
    assert n == 1 << 25 and any(marks) and components._state(links.limit(0)) == (0, 0, 0)


@pytest.mark.parametrize("size", [64, 4096])
def test_finer_codes_keep_recall(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((150, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal(a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = capfilter.CapFilters(64, size)
    found = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    assert np.mean(found) >= 0.99


def test_false_edges_displace_no_link():
    """Links of a pair of blocks come from whole cells: equal upper halves count for nothing."""
    import pyarrow as pa

    low = np.arange(10, dtype=np.uint64)
    high = low << np.uint64(32)
    sets = [high, high + np.uint64(1), high.copy()]  # 0 and 2 are equal, 1 has only its upper halves in common
    rows = pa.table(
        {
            "block": pa.array([0, 1], pa.int32()),
            "uids": [np.array([0], np.int64).tobytes(), np.array([1, 2], np.int64).tobytes()],
            "components": [np.array([0], np.int64).tobytes(), np.array([1, 2], np.int64).tobytes()],
            "sizes": [np.array([10], np.int64).tobytes(), np.array([10, 10], np.int64).tobytes()],
            "cells": [sets[0].tobytes(), np.concatenate(sets[1:]).tobytes()],
        }
    )
    got = dartminhash._block_links(0.8)((), rows).to_pylist()
    assert got == [{"a": 0, "b": 2}]
