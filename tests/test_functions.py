"""Functions and kernels against plain Python, and the traps of the data model."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import formulas, goals, grammar, hunks, sexp, spans, text, versions
from tessella.operators import alignment, graphs, metadata, records, sampling, sequences, snapshots


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text(max_size=30), st.text(max_size=30))
@settings(max_examples=150, deadline=None)
def test_edit_distance(a, b):
    assert alignment.edit_distance(a, b) == levenshtein(a, b)


ORDER = ["~~", "~", "~beta2", "~beta10", "0.1", "1.0~beta", "1.0", "1.0-test", "1.0.1", "1.0.10", "8.9.1", "8.10.2", "8.15.2", "dev", "trunk"]


def test_version_order(spark):
    mixed = random.Random(1).sample(ORDER, len(ORDER))
    df = spark.createDataFrame([(v,) for v in mixed], "v string")
    assert [r.v for r in df.orderBy(versions.version_key(F.col("v"))).collect()] == ORDER
    assert sorted(mixed, key=formulas.sort_key) == ORDER
    tops = df.filter(F.col("v").startswith("8.")).agg(versions.max_version(F.col("v")).alias("a"), versions.max_version(F.col("v"), "opam").alias("b"))
    assert tuple(tops.first()) == ("8.9.1", "8.15.2")


def test_norms(spark):
    df = spark.createDataFrame([("ab", "ab"), ("", ""), ("", "x"), ("é", "e"), ("abcd", "abxd")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(*[text.norm_edit_distance(a, b, n).alias(n) for n in text.NORMS]).collect()
    assert tuple(got[0]) == (0.0, 0.5, 0.0)
    assert tuple(got[1]) == (0.0, 0.0, 0.0)
    assert got[2]["max"] == 1.0 and got[2]["product"] is None
    assert got[3]["max"] == 1.0
    assert got[4]["tanimoto"] == pytest.approx(2 / 9)
    with pytest.raises(ValueError):
        text.clipped(F.lit(1.0), -1)


def test_strings(spark):
    df = spark.createDataFrame([(' a\t b "q" ', "my-coq-lib", "A.B.C", "p/q.x.v")], "s string, n string, l string, p string")
    row = df.select(
        text.normalize_spaces(F.col("s")).alias("spaces"),
        text.quote_escape(F.col("s")).alias("quoted"),
        text.unquote(F.lit('"x"')).alias("unquoted"),
        text.name_variants(F.col("n")).alias("names"),
        text.logical_parents(F.col("l")).alias("parents"),
        text.logical_short_names(F.col("l")).alias("short"),
        text.is_relative_to(F.col("l"), F.lit("A.B")).alias("rel"),
        text.change_suffix(F.col("p"), ".vo").alias("vo"),
        text.canonical_url(F.lit("https://x/y.git")).alias("url"),
        text.split_label(F.lit("a, b, L"))[1].alias("label"),
        text.byte_offset(F.lit("é1"), F.lit(1)).alias("bytes"),
    ).first()
    assert row["spaces"] == 'a b "q"'
    assert row["quoted"] == '" a\t b \\"q\\" "'
    assert row["unquoted"] == "x"
    assert {"my-lib", "my_lib", "MyLib", "my-coq-lib"} <= set(row["names"])
    assert (row["parents"], row["short"], row["rel"]) == (["A.B", "A"], ["C", "B.C", "A.B.C"], True)
    assert (row["vo"], row["url"], row["label"], row["bytes"]) == ("p/q.x.vo", "https://x/y", "L", 2)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (4, 2), (2, 5), (5, 5)] * 4:
        cost = np.minimum(rng.random((n, m)), 0.4)
        pairs = alignment.assign(cost)
        assert len(pairs) == min(n, m)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_ordered_alignment():
    rng = random.Random(5)
    for _ in range(20):
        a = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 6))]
        b = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 6))]
        cost = alignment.cost_matrix(a, b)
        got = alignment.align_ordered(cost, 0.3)
        total = sum(cost[i, j] if i is not None and j is not None else 0.3 for i, j in got)
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                options = [0.0] if not i and not j else []
                if i:
                    options.append(table[i - 1, j] + 0.3)
                if j:
                    options.append(table[i, j - 1] + 0.3)
                if i and j:
                    options.append(table[i - 1, j - 1] + cost[i - 1, j - 1])
                table[i, j] = min(options)
        assert total == pytest.approx(table[-1, -1])
        assert [i for i, _ in got if i is not None] == list(range(len(a)))
    with pytest.raises(ValueError):
        alignment.align_ordered(np.zeros((2, 2)), mask=np.zeros((1, 2), bool))


def test_alignment_traps():
    # a pair at exactly the threshold is no match
    assert alignment.assign_below(["abcd"], ["abxy"], alignment.tanimoto("abcd", "abxy")) == []
    assert alignment.align_with_diff(["a", "b", "c"], ["a", "c"], [False, True, False], [False, False]) == [(0, 0), (2, 1)]
    with pytest.raises(ValueError):
        alignment.align_with_diff(["a", "b"], ["a"], [False, False], [False])
    with pytest.raises(IndexError):
        alignment.check_alignment([(0, 5)], 1, 2)


def test_formulas(spark):
    f = formulas.parse_version_formula('>= "4.2" & <= "5.1.2"')
    kept = f.filter(["0.1", "4.1.0", "4.2~", "4.2", "4.2.0~", "5.0~", "5.1.2", "5.2.0", "6"])
    assert kept == ["4.2", "4.2.0~", "5.0~", "5.1.2"]
    g = formulas.parse_version_formula('>= "0.7.1" & (< "1.0.0" | build) & !with-test')
    assert g.satisfied("2.0", {"build": True, "with-test": False})
    assert not g.satisfied("2.0", {"build": True})  # undefined
    assert str(g.simplify("0.8", {"with-test": None})) == "!(with-test)"
    df = spark.createDataFrame([("0.8", "true", "false"), ("0.8", None, None), ("0.1", "true", "false"), ("2.0", "true", "false")], "v string, b string, t string")
    got = df.select(g.column(F.col("v"), {"build": F.col("b"), "with-test": F.col("t")}).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, True]
    p = formulas.parse_package_formula('"a" {>= "1"} & ("b" {with-test} | "c") & "d" {dev & > "2"}')
    assert formulas.packages(p) == {"a", "b", "c", "d"} and formulas.size(p) == 3
    assert p.satisfied({"a": "1.0"}, {})  # what is filtered out is not required
    assert not p.satisfied({"a": "0.9"}, {})
    assert not p.satisfied({"a": "1"}, {"with-test": True})
    assert p.simplify({"a": "1"}, {"dev": True}) == formulas.Package("d", formulas.Relation(">", "2"))
    for bad in ["", '>= ', '"a" |', '(build', 'build )']:
        with pytest.raises(formulas.ParseError):
            formulas.parse_version_formula(bad)
    assert formulas.closest([("x", {}), ("y", {"a": "1"}), ("z", {"a": "2"})], formulas.parse_package_formula('"a" & "d"')) == "y"


def atoms():
    return st.recursive(st.text("abc", min_size=1, max_size=3), lambda s: st.lists(s, max_size=4), max_leaves=15)


@given(atoms())
@settings(max_examples=100, deadline=None)
def test_sexp_round_trip(node):
    assert sexp.parse(sexp.dump(node)) == node
    height, nodes, leaves = sexp.metrics(node)
    assert nodes >= leaves >= 1 and height < nodes
    assert sexp.modify(node, lambda x: None) == node
    assert [x for x, _ in sexp.backward(node)][-1] == node


def test_sexp():
    assert sexp.metrics(sexp.parse('(a (b "c d") ())')) == (2, 6, 4)
    assert sexp.modify(["a", ["b"]], lambda x: "z" if x == "b" else None) == ["a", ["z"]]
    deep = "(" * 5000 + "x" + ")" * 5000
    assert sexp.metrics(sexp.parse(deep))[0] == 5000
    with pytest.raises(ValueError):
        sexp.parse("(a")


def test_hunks():
    diff = "\n".join(
        ["diff --git a/f.v b/g.v", "rename from f.v", "rename to g.v", "--- a/f.v", "+++ b/g.v", "@@ -3 +3,2 @@", "-old", "+new", "+--- x", "@@ -9,0 +11 @@", "+tail",
         "diff --git a/h.v b/h.v", "--- a/h.v", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-a", "-b", "diff --git a/p b/q", "rename from p", "rename to q"]
    )
    assert list(hunks.parse_diff(diff)) == [
        ("f.v", "g.v", 3, 4, 3, 5, ["old"], ["new", "--- x"]),
        ("f.v", "g.v", 9, 9, 11, 12, [], ["tail"]),
        ("h.v", None, 1, 3, 0, 0, ["a", "b"], []),
        ("p", "q", 0, 0, 0, 0, [], []),
    ]


def test_sentences():
    source = 'Lemma a : x. (* c (* n. *) . *)\nProof. - auto. + { split. }\n  Check "a ""b. c". Qed.\nRequire Import A B.'
    got = list(grammar.split_sentences(source))
    assert [s.text for s in got] == ["Lemma a : x.", "Proof.", "-", "auto.", "+", "{", "split.", "}", 'Check "a ""b. c".', "Qed.", "Require Import A B."]
    assert all(source[s.start : s.end].split()[0] == s.text.split()[0] for s in got)
    assert [grammar.kind(s.text) for s in got][-3:] == ["query", "proof_ender", "requirement"]
    glommed = grammar.glom_proofs([s.text for s in got])
    assert len(glommed) == 3 and glommed[1].endswith("Qed.")
    assert grammar.kind("rewrite x.") == grammar.kind("revgoals.") == "tactic"
    assert [c for c, _, _ in grammar.comments(source)] == ["(* c (* n. *) . *)"]


def test_kinds_in_spark(spark):
    rows = ["Lemma a.", "#[local] Definition f.", "Time auto.", "Qed.", "-", "From A Require Import B C.", "Foo bar.", "Proof with x.", "Obligations."]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = df.select("s", grammar.kind_column(F.col("s")).alias("k"), grammar.requirements(F.col("s")).alias("r")).collect()
    assert [r.k for r in got] == [grammar.kind(s) for s in rows]
    assert got[5].r == ["A.B", "A.C"]


state = st.fixed_dictionaries(
    {
        "foreground": st.lists(st.sampled_from("abcd"), max_size=4),
        "background": st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=2), st.lists(st.sampled_from("abcd"), max_size=2)), max_size=3),
        "shelved": st.lists(st.sampled_from("abcd"), max_size=2),
        "abandoned": st.lists(st.sampled_from("abcd"), max_size=2),
    }
)


@given(state, state)
@settings(max_examples=150, deadline=None)
def test_goal_patches(a, b):
    assert goals.patch(a, goals.compute_diff(a, b)) == b
    assert not any(goals.compute_diff(a, a)[k] for k in ("added", "removed", "moved"))
    assert list(goals.carry(list(goals.compress([a, b, a])))) == [a, b, a]


def test_spans(spark):
    df = spark.createDataFrame([(("f", 1, 0, 5, 80, 0, 100), ("f", 2, 20, 2, 20, 25, 30))], f"a struct<{spans.SCHEMA.replace(' ', ':').replace(',:', ',')}>, b struct<{spans.SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        spans.contains(a, b).alias("c"),
        spans.intersects(a, b).alias("i"),
        spans.intersects(b, a, by_line=True).alias("asym"),
        (spans.patched(a, spans.difference(a, b)) == b).alias("inv"),
        spans.in_hunk(b, F.lit(3), F.lit(3)).alias("empty"),
        spans.in_hunk(a, F.lit(3), F.lit(3)).alias("inside"),
    ).first()
    assert (row.c, row.i, row.asym, row.inv, row.empty, row.inside) == (True, True, False, True, False, True)


def test_snapshot_round_trip(spark):
    rng = random.Random(2)

    def rows():
        return spark.createDataFrame([(i, rng.choice("ab"), rng.choice([None, 1, 2])) for i in range(40) if rng.random() < 0.7], "k int, t string, x int")

    a, b = rows(), rows()
    diff = snapshots.snapshot_diff(a, b, ["k"], "t", ["x"])
    assert sorted(snapshots.apply_diff(a, diff, ["k"], ["t", "x"]).collect(), key=str) == sorted(b.collect(), key=str)
    assert snapshots.snapshot_diff(a, a, ["k"], "t", ["x"]).filter("kind <> 'unchanged'").isEmpty()


def test_offsets_reject_overlaps(spark):
    spans_ = spark.createDataFrame([("f", 1, 0, 5), ("f", 2, 10, 15)], "file string, cmd int, beg int, end int")
    ok = spark.createDataFrame([("f", 1, 0, 5, 7)], "file string, cmd int, beg int, end int, excess int")
    assert [(r.cmd, r.beg) for r in snapshots.shifted_by_offsets(spans_, ok, ["file"]).orderBy("cmd").collect()] == [(1, 0), (2, 17)]
    bad = spark.createDataFrame([("f", 1, 0, 12, 7)], "file string, cmd int, beg int, end int, excess int")
    with pytest.raises(Exception, match="overlaps"):
        snapshots.shifted_by_offsets(spans_, bad, ["file"]).collect()


META = "project_name string, project_url string, commit_sha string, coq_version string, ocaml_version string, build string, clean string"


def test_metadata(spark):
    store = spark.createDataFrame(
        [("p", None, None, None, None, "make", "rm"), ("p", "u", None, None, None, "dune", None), ("p", "u", "c", "8.10", None, None, "none")], META
    )
    probes = spark.createDataFrame([("p", "u", "c", "8.10", "4"), ("p", "u", "d", None, None), ("p", None, None, "8.9", None), ("q", None, None, None, None)], META.rsplit(", build", 1)[0])
    got = {tuple(r)[:3]: (r.build, r.clean) for r in metadata.fallback(probes, store, ["build", "clean"]).collect()}
    assert got == {("p", "u", "c"): ("dune", "none"), ("p", "u", "d"): ("dune", "rm"), ("p", None, None): ("make", "rm")}
    new = spark.createDataFrame([("p", "u", "e", None, None, "dune", "x")], META)
    added = metadata.insert(store, new, ["build", "clean"]).filter("commit_sha = 'e'").first()
    assert (added.build, added.clean) == (None, "x")  # what is inherited isn't stored
    with pytest.raises(Exception, match="there already"):
        metadata.insert(store, store.limit(1), ["build", "clean"]).collect()
    assert metadata.remove(store, store.filter("project_url is null")).count() == 2
    assert metadata.coq_versions(store, "p").count() == 0
    assert metadata.coq_versions(store, "p", "c").first().coq_version == "8.10"


def test_records(spark):
    def rows(*n):
        return spark.createDataFrame([("p", "a", "b", "8.10.2", "8.10.2", str(i), "x", "y", "z") for i in n], ", ".join(f"{k} string" for k in records.KEY))

    empty = spark.createDataFrame([], records.SCHEMA)
    first = records.insert(empty, rows(1, 1))
    again = records.insert(first, rows(1, 2))
    got = again.orderBy("id").collect()
    assert [r.id for r in got] == [1, 2]
    assert [r.file_name for r in got] == ["p-a-b-8_10_2-8_10_2-0.json", "p-a-b-8_10_2-8_10_2-1.json"]
    merged = records.merge([first, records.insert(empty, rows(1, 3))])
    assert [r.id for r in merged.orderBy("id").collect()] == [1, 2]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "src string, dst string")
    assert {r.node: r.level for r in graphs.levels(edges).collect()} == {"a": 0, "x": 0, "b": 1, "y": 1, "c": 2}
    order = graphs.topological(edges)
    assert graphs.order_violations(order, edges).isEmpty()
    assert {r.node: r.component for r in graphs.connected(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    cycle = edges.union(spark.createDataFrame([("c", "a")], "src string, dst string"))
    with pytest.raises(ValueError):
        graphs.levels(cycle)


def test_sequences(spark):
    df = spark.createDataFrame([("p", i, f"s{i}") for i in range(5)], "p string, t int, sha string")
    start = F.col("sha") == "s2"

    def walk(strategy):
        return [r.sha for r in sequences.traversal(df, ["p"], ["t"], start, strategy).orderBy("step").collect()]

    assert walk("new_first") == ["s2", "s1", "s0"]
    assert walk("old_first") == ["s2", "s3", "s4"]
    assert walk("curlicue_new") == ["s2", "s3", "s1", "s4", "s0"]
    assert walk("curlicue_old") == ["s2", "s1", "s3", "s0", "s4"]
    allowed = df.filter("sha <> 's2'").select("sha")
    pairs = sequences.allowed_pairs(df, ["p"], ["t"], "sha", allowed).select("sha", "next_sha").collect()
    assert sorted(map(tuple, pairs)) == [("s0", "s1"), ("s3", "s4")]  # the list applies after pairing
    assert sequences.first_n(df, ["p"], ["t"], 0, at_least_one=True).count() == 1


def test_split(spark):
    df = spark.createDataFrame([(f"g{i}", 10 + i) for i in range(200)], "g string, n long")
    out = sampling.split(df, "g", "n", {"train": 0.8, "test": 0.1, "validation": 0.1})
    share = {r.split: r.s for r in out.groupBy("split").agg((F.sum("n") / 21900).alias("s")).collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert out.filter("g = 'g199'").first().split == "train"
    heavy = spark.createDataFrame([(i, 1000.0 if i < 5 else 0.001) for i in range(500)], "i long, w double")
    assert {r.i for r in sampling.weighted_sample(heavy, "i", F.col("w"), 5).collect()} == set(range(5))
