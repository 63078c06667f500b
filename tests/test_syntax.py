"""Identifiers and locations of serialised trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import names, sexp, syntax

LOC = "(loc (((fname ToplevelInput) (line_nb 1) (bol_pos 0) (line_nb_last 2) (bol_pos_last 10) (bp {0}) (ep {1}))))"
TREE = (
    "((v (VernacDefinition ((v (Name (Id foo))) " + LOC.format(3, 9) + ") "
    "(CRef ((v (Ser_Qualid (DirPath ((Id A) (Id B))) (Id x))) " + LOC.format(11, 20) + ") ()) "
    "(CPatAtom (((v (Ser_Qualid (DirPath ()) (Id y))) ()))) (Ser_Qualid (DirPath ()) (Id z)) ((v (Id h)) " + LOC.format(30, 31) + "))))"
)


def test_identifiers():
    assert list(syntax.identifiers(sexp.parse(TREE))) == [("lname", "foo"), ("CRef", "A.B.x"), ("CPatAtom", "y"), ("Ser_Qualid", "z"), ("lident", "h")]
    again = syntax.qualify(sexp.parse(TREE), {"y": "M.N.y"})
    assert ("CPatAtom", "M.N.y") in list(syntax.identifiers(again))


def test_in_spark(spark):
    df = spark.createDataFrame([(TREE,), (None,)], "t string")
    row = df.select(
        syntax.referenced(F.col("t")).alias("names"),
        syntax.locations(F.col("t")).alias("locs"),
        syntax.locations(syntax.shifted(F.col("t"), F.lit(100), F.lit(5))).alias("moved"),
        syntax.vernac_kind(F.col("t")).alias("kind"),
    ).collect()
    assert row[0].names == ["A.B.x", "foo", "h", "y", "z"] and row[0].kind == "VernacDefinition"
    assert [(x.beg_charno, x.end_charno) for x in row[0].locs] == [(3, 9), (11, 20), (30, 31)]
    assert [(x.lineno, x.beg_charno, x.bol_pos_last) for x in row[0].moved] == [(6, 103, 10), (6, 111, 10), (6, 130, 10)]
    assert row[1].names is None and row[1].kind is None


FILE = "(MPfile (DirPath ((Id Lists) (Id Coq))))"
PATHS = {
    "(DirPath ((Id C) (Id B) (Id A)))": "A.B.C",
    "(DirPath ())": "",
    FILE: "Coq.Lists",
    f"(MPdot (MPdot {FILE} (Label (Id M))) (Label (Id N)))": "Coq.Lists.M.N",
    f"(MPdot {FILE} (Id M))": "Coq.Lists.M",
    "(MPbound (MBId 3 (Id X) (DirPath ((Id A)))))": "A.X",
    f"(KerName {FILE} (Id app))": "Coq.Lists.app",
    f"(KerName {FILE} (DirPath ()) (Id app))": "Coq.Lists.app",
    f"(KerName 0 {FILE} (DirPath ((Id S))) (Id app))": "Coq.Lists#S#app",
}


def test_printed_names(spark):
    df = spark.createDataFrame([(t,) for t in [*PATHS, None]], "t string")
    assert {r.t: r.n for r in df.select("t", names.printed(F.col("t")).alias("n")).collect()} == {**PATHS, None: None}
    assert names.library_of(sexp.parse(f"(MPdot (MPdot {FILE} (Label (Id M))) (Label (Id N)))")) == "Coq.Lists"


def test_interpolated_names(spark):
    df = spark.createDataFrame([("x", "A.B.x"), ("B.x", "A.B.x"), ("x", "x"), (None, "x")], "s string, f string")
    got = [r.n for r in df.select(names.interpolated(F.col("s"), F.col("f")).alias("n")).collect()]
    assert got == [["x", "B.x", "A.B.x"], ["B.x", "A.B.x"], ["x"], None]
    with pytest.raises(Exception, match="not related"):
        spark.createDataFrame([("y", "A.x")], "s string, f string").select(names.interpolated(F.col("s"), F.col("f"))).collect()
