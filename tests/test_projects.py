"""Project graphs from files, load paths and sentences."""

from __future__ import annotations

from tessella.operators import projects

FILES = [("p", "lib/comp/A.v"), ("p", "lib/B.v"), ("p", "Makefile"), ("p", None), ("q", "C.v"), ("q", "C.v")]
PATHS = [("p", "./lib/comp", "Comp"), ("p", ".", "P"), ("p", "lib/B.v", "Short"), ("q", "lib", "None")]


def rows(df):
    return {tuple(r) for r in df.collect()}


def graph(spark, files=FILES, paths=PATHS):
    files = spark.createDataFrame(files, "project string, path string")
    edges, found = projects.add_files(files), projects.libraries(files)
    return edges, found, projects.add_aliases(found, spark.createDataFrame(paths, "project string, folder string, name string"))


def test_files(spark):
    edges, found, _ = graph(spark)
    assert {r[:3] for r in rows(edges)} == {
        ("p", "", "lib"), ("p", "lib", "lib/comp"), ("p", "lib/comp", "lib/comp/A.v"), ("p", "lib", "lib/B.v"), ("p", "", "Makefile"), ("q", "", "C.v")
    }
    assert edges.count() == 6
    assert {r[2] for r in rows(found) if r[0] == "p"} == {"lib", "lib.comp", "lib.comp.A", "lib.B"}


def test_aliases(spark):
    _, _, aliases = graph(spark)
    assert {r[1:] for r in rows(aliases)} == {
        ("Comp", "lib.comp"), ("Comp.A", "lib.comp.A"), ("Short", "lib.B"), ("P.lib", "lib"), ("P.lib.comp", "lib.comp"), ("P.lib.comp.A", "lib.comp.A"), ("P.lib.B", "lib.B")
    }


def test_dependencies(spark):
    _, found, aliases = graph(spark)
    sentences = [("q", "C", "Require Import Comp.A."), ("q", "C", "From X Require Export Comp."), ("p", "lib.B", "Lemma a : b."), ("p", "lib.B", None)]
    required = projects.add_requirements(spark.createDataFrame(sentences, "project string, library string, text string"))
    assert rows(required) == {("q", "C", "Comp.A"), ("q", "C", "X.Comp")}
    assert rows(projects.add_dependencies(required, found, aliases)) == {
        ("q", "Comp.A", "C", "DependencyToRequirement"),
        ("q", "X.Comp", "C", "DependencyToRequirement"),
        ("q", "Comp.A", "p:lib.comp.A", "DependencyToLibrary"),
        ("q", "X.Comp", "p:lib.comp", "DependencyToLibrary"),
    }


def test_empty(spark):
    edges, found, aliases = graph(spark, [], [])
    assert edges.isEmpty() and found.isEmpty() and aliases.isEmpty()
