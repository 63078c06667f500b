"""Repair mining, goal states, load paths, settings and traces."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessella.functions import options
from tessella.operators import goals as states
from tessella.operators import repairs, sequences


def test_mining(spark):
    schema = "pair int, file string, idx int, text string, proof string"
    before = spark.createDataFrame([(1, "f", 0, "a", "x"), (1, "f", 1, "b", "y"), (1, "f", 2, "c", "z"), (1, "f", 3, "d", "w")], schema)
    after = spark.createDataFrame([(1, "f", 0, "a2", "x"), (1, "f", 1, "b2", "y2"), (1, "f", 2, "c", "z2"), (1, "f", 4, "e", "v")], schema)
    diff = repairs.changes(before, after)
    assert {r.idx: r.kind for r in diff.collect()} == {0: "changed", 1: "changed", 2: "affected", 3: "dropped", 4: "added"}
    sets = repairs.changesets(diff)
    assert sorted((r.broken.idx, [c.idx for c in r.changed], len(r.added), len(r.dropped)) for r in sets.collect()) == [(0, [1], 1, 1), (1, [0], 1, 1)]
    state = repairs.broken_states(before, diff, sets).filter("b_idx = 1").orderBy("idx").collect()
    assert [(r.idx, r.text, r.proof, r.broken) for r in state] == [(0, "a2", "x", False), (1, "b", "y", True), (2, "c", "z2", False), (4, "e", "v", False)]
    found = repairs.repairs(before, after, spark.createDataFrame([(1, ["t"])], "pair int, tags array<string>"))
    assert {r.idx: r.tags for r in found.collect()} == {
        0: ["error:t", "repair:specification"],
        1: ["error:t", "repair:specification", "repair:proof"],
        2: ["error:t", "repair:proof"],
    }
    assert repairs.filtered(found, ["repair:proof"]).count() == 2 and repairs.filtered(found, []).count() == 3
    same = repairs.changes(before, before)
    assert same.filter("kind <> 'unchanged'").isEmpty() and repairs.changesets(same).isEmpty()


def test_goal_states(spark):
    a = {"foreground": ["p"], "background": [(["q"], [])], "shelved": [], "abandoned": []}
    b = {"foreground": ["q", "r"], "background": [], "shelved": ["p"], "abandoned": []}
    rows = [(1, 0, json.dumps(a)), (1, 1, json.dumps(b)), (1, 2, json.dumps(a))]
    df = spark.createDataFrame(rows, "proof int, step int, goals string")
    small = states.compressed(df, ["proof"], ["step"])
    assert small.filter("goals like '%added%'").count() == 2
    back = states.carried(small, ["proof"], ["step"]).orderBy("step").collect()
    assert [json.loads(r.goals) for r in back] == [json.loads(r[2]) for r in rows]
    gap = small.withColumn("goals", F.when(F.col("step") != 2, F.col("goals")))
    assert states.facts(states.carried(gap, ["proof"], ["step"])).orderBy("step").select("n_goals").collect()[2][0] == 3


def test_options(spark):
    args = "array('-R', 'a/b', 'X', '-x', '-I', 'ml', '-Q', 'a', 'Y', '-R', 'dangling')"
    row = (
        spark.sql(f"SELECT {args} AS args")
        .withColumn("p", options.load_path(F.col("args")))
        .select(
            "p",
            options.logical_name(F.col("p"), F.lit("a/b/c/d.v")).alias("name"),
            options.logical_name(F.col("p"), F.lit("z.v")).alias("none"),
            options.relocated(F.col("p"), F.lit("a"), F.lit("w")).alias("moved"),
            options.settings_map(F.lit("Printing All: on\nDepth: 12\nTitle\n")).alias("s"),
            options.warnings_map(F.lit("a,-b,+c,a,-a")).alias("w"),
            options.setting_command(F.lit("Depth"), F.lit("12")).alias("cmd"),
        )
        .first()
    )
    assert (row.p.I, [tuple(x) for x in row.p.Q], [tuple(x) for x in row.p.R]) == (["ml"], [("a", "Y")], [("a/b", "X")])
    assert (row["name"], row["none"]) == ("X.c.d", None)
    assert row.moved.R[0].dir == "w/b" and row.moved.Q[0].dir == "w"
    assert row.s == {"Printing All": "true", "Depth": "12"} and row.cmd == "Set Depth 12."
    assert row.w == {"a": "disabled", "b": "disabled", "c": "error"}


def test_traces(spark):
    lines = [
        r'12 execve("/bin/coqc", ["coqc", "-Q", "a\303\251", "f.v"], ["PWD=/x", "A=1=2"]) = 0',
        r'13 execve("/bin/coqc", ["coqc", "g.v"], ["PWD=/y"]) = -1 ENOENT',
        "14 exited",
    ]
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    got = options.traced(df, "line", r".*\.v").collect()
    assert [(r.executable, r.args[2], r.pwd, r.env["A"], r.target) for r in got] == [("/bin/coqc", "aé", "/x", "1=2", "f.v")]


def test_versions_tables(spark):
    table = spark.createDataFrame([("8.9", "1"), ("8.9", "1.10"), ("8.9", "1.9")], "coq string, serapi string")
    assert options.latest_compatible(table, "serapi").first().serapi == "1.10"
    probes = spark.createDataFrame([("8.9", "1"), ("8.9", "2"), (None, "2")], "coq string, serapi string")
    assert sorted(str(r.compatible) for r in options.compatible(probes, table, "serapi").collect()) == ["False", "True", "True"]


def test_numbered(spark):
    df = spark.range(0, 1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = sequences.numbered(df, ["k", "id"], "place", start=5).orderBy("k", "id").select("place").collect()
    assert [r.place for r in got] == list(range(5, 1005))
