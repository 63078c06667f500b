"""Quality classifier and language identification."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, ordinal
from tessella.llm.queries import op1_quality, op4_language_id, quality_model
from tessella.sources.tables import load

SF = "/root/testdata/sf0.1"


def test_thresholds_are_ordered_and_learn():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        texts.append(" ".join([*rng.choice(words, 30), *[f"mark{g}"] * int(rng.integers(1, 4))]))
        grades.append(g)
    model = ordinal.fit(*ordinal.features(texts[:600]), np.array(grades[:600]), 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.score(texts[600:])
    assert (np.diff(tails, axis=1) <= 1e-9).all()  # tail probabilities fall with the grade
    error = np.abs(tails.sum(axis=1) - np.array(grades[600:])).mean()
    assert error < 0.6


def test_gradient():
    """The fit lowers the negative log likelihood below that of the thresholds alone."""
    texts, grades = ["a b", "c d", "a c", "d e"] * 25, np.array([0, 1, 0, 2] * 25)
    model = ordinal.fit(*ordinal.features(texts), grades, 3)
    tails = model.score(texts)
    p = np.concatenate([1 - tails[:, :1], tails[:, :1] - tails[:, 1:], tails[:, 1:]], axis=1)
    assert -np.log(p[np.arange(100), grades]).mean() < 0.4


def test_quality_on_held_out_rows(spark):
    """Ratings that the fit hasn't seen: poor documents go, clean ones stay."""
    docs = load(spark, SF, "documents")
    rated = load(spark, SF, "labels").withColumn("grade", ordinal.grade_of(F.col("quality"), F.col("toxic")))
    seen = rated.filter("doc_id % 3 <> 0").select("doc_id", "grade")
    model = ordinal.train(docs, seen)
    kept = ordinal.score(docs, model).join(rated.filter("doc_id % 3 = 0"), "doc_id").groupBy("grade").avg("tail_prob").collect()
    share = {r.grade: r[1] for r in kept}
    assert share[0] < 0.1 and share[2] > 0.9 and share[0] < share[1] < share[2]


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "good text " * 20_000), (4, "good text " * 20_000), (None, "fine words here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, grade int")
    model = ordinal.train(df, none)
    got = ordinal.score(df, model).collect()
    assert [(r.doc_id, r.kept) for r in got] == [(1, False), (2, False), (3, False), (4, True), (4, True), (None, True)]
    assert ordinal.select(df, model).columns == df.columns and ordinal.select(df, model).count() == 3
    assert ordinal.score(df.limit(0), model).count() == 0


def test_quality_query(spark):
    got = op1_quality(spark, "/root/testdata/sf0.01")
    assert got.count() == 1000
    assert got.filter("tail_prob < 0 or tail_prob > 1 or expected_grade < tail_prob").isEmpty()


def test_language_query(spark):
    docs = {r.doc_id: r for r in load(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = op4_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("n", [3, 70])
def test_filter_returns_all_languages(n):
    """A gram's mask holds every language that it was filed under; extra bits come by chance only."""
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32)
    member = rng.random((3000, n)) < 0.3
    slices = np.zeros((-(-n // 64), 1 << 16), np.uint64)
    for lang in range(n):
        for s in langid.slots_of(codes[member[:, lang]], 16):
            slices[lang // 64, s] |= np.uint64(1) << np.uint64(lang % 64)
    f = langid.LanguageFilter([str(i) for i in range(n)], slices, 0)
    for lang in range(n):
        got = (f.containing(codes, lang // 64) >> np.uint64(lang % 64)) & np.uint64(1) > 0
        assert got[member[:, lang]].all()
        assert got[~member[:, lang]].mean() < 2 * f.chance[lang] + 0.01


def test_language_edges(spark):
    english, german = "the quick brown fox and the other words ", "der schnelle braune fuchs und die anderen "
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "漢字", None), (104, english * 90_000, None), (None, german, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert got[103].lang_pred in ("en", "de") and got[103].score == 0
    assert (got[104].lang_pred, got[None].lang_pred, got[None].held_out) == ("en", "de", False)
    nothing = langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).filter("false"))
    assert nothing.count() == 0
    unlabelled = langid.identify(df.filter("lang is null"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def plain_features(text):
    """The features of a text, by name, as the docstring states them."""
    import re

    words = (text or "").split()
    out = Counter()
    for w in set(words):
        kind = "A" if w.isupper() and len(w) > 1 else "a"
        shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", kind, w))
        out["w:" + w.lower()] += len(set(words)) ** -0.5
        out["s:" + shape] += 1 / len(set(words))
    if words:
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[f"r:{int(10 * again)}"] += 0.5
        out[f"u:{int(10 * len(set(words)) / len(words))}:{len(words).bit_length()}"] += 0.5
    else:
        out["none"] += 1.0
    return out


def test_scores_by_brute_force(spark):
    """Scores of a query equal the formula over features by name."""
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    model = quality_model(docs, spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in ordinal.score(docs, model).collect():
        x = sum(v * float(model.weights[zlib.crc32(k.encode()) % ordinal.DIMENSION]) for k, v in plain_features(texts[r.doc_id]).items())
        tails = 1 / (1 + np.exp(model.thresholds - x)) if texts[r.doc_id].strip() else np.zeros(2)
        assert r.tail_prob == pytest.approx(tails[1], abs=1e-4) and r.expected_grade == pytest.approx(tails.sum(), abs=2e-4)


def test_fit_by_plain_gradient():
    """The fit is about as good as plain gradient descent on the same likelihood."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(2, 5))) for _ in range(200)]
    grades = np.array([min(2, t.count("a") + t.count("b")) for t in texts])
    names = sorted({k for t in texts for k in plain_features(t)})
    x = np.array([[plain_features(t)[k] for k in names] for t in texts])

    def loss(p):
        return -np.log(np.maximum(p[np.arange(200), grades], 1e-9)).mean()

    w, cut = np.zeros(len(names)), np.array([-0.5, 0.5])

    def chances():
        below = np.concatenate([np.zeros((200, 1)), 1 / (1 + np.exp(-(cut[None] - (x @ w)[:, None]))), np.ones((200, 1))], axis=1)
        return np.diff(below, axis=1), below

    for _ in range(4000):
        p, below = chances()
        lo, hi = below[np.arange(200), grades], below[np.arange(200), grades + 1]
        own = np.maximum(hi - lo, 1e-9)
        w -= 0.5 * (x * ((hi * (1 - hi) - lo * (1 - lo)) / own)[:, None]).mean(0)
        for k in range(2):
            s = below[:, k + 1] * (1 - below[:, k + 1])
            cut[k] -= 0.5 * (np.where(grades == k, -s, 0) + np.where(grades == k + 1, s, 0)).dot(1 / own) / 200
    model = ordinal.fit(*ordinal.features(texts), grades, 3)
    tails = model.score(texts)
    ours = np.concatenate([1 - tails[:, :1], tails[:, :1] - tails[:, 1:], tails[:, 1:]], axis=1)
    assert loss(ours) <= loss(chances()[0]) + 0.02


def test_repeated_ids_teach_the_same(spark):
    rows = [(i % 20, f"{'good fine' if i % 2 else 'bad junk'} text {i}") for i in range(60)]
    graded = spark.createDataFrame([(i, i % 3) for i in range(20)], "doc_id long, grade int")
    models = [ordinal.train(spark.createDataFrame(some, "doc_id long, text string").repartition(n), graded) for some, n in ((rows, 1), (rows[::-1], 5))]
    assert (models[0].weights == models[1].weights).all()


def test_language_by_brute_force(spark):
    """Predictions equal those of exact n-gram sets, kept without a filter."""
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    def grams(text):
        b = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in f" {text.lower()} ".encode())
        return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]

    counts = defaultdict(Counter)
    for r in rows.values():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            counts[r.lang].update(grams(r.text))
    rates = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = Counter()
    for own in rates.values():
        for g, x in own.items():
            top[g] = max(top[g], x)
    sets = {k: {g for g, x in own.items() if x >= langid.MIN_RATE and x * langid.SHARE >= top[g]} for k, own in rates.items()}
    same = []
    for r in langid.identify(docs).collect():
        found = grams(rows[r.doc_id].text or "")
        hits = {k: sum(g in sets[k] for g in found) for k in sorted(sets)}
        if r.lang_pred != langid.UNKNOWN and sum(hits.values()):
            best = max(hits, key=lambda k: hits[k])
            same.append(r.lang_pred == best and abs(r.score - hits[best] / sum(hits.values())) < 0.05)
    assert len(same) > 100 and np.mean(same) >= 0.98


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.identify(df)
