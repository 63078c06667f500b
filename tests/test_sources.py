"""Sources, sinks and streaming ingest."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import cache, formats
from tessella.streaming import ingest


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("p", "c1", "8.10.2", 1), ("p", "c2", "8.11.2", 2), ("q", "c1", "8.9.1", 1), ("q", "c3", "9.9", 4)]
    df = spark.createDataFrame(rows, "project string, commit_hash string, coq_version string, status int")
    cache.write(df, path)
    back = cache.scan(spark, path, "status int, project string, commit_hash string, coq_version string")
    assert back.count() == 4
    assert cache.status(back).count() == 3
    assert cache.status(back, projects=["p"]).count() == 2
    assert cache.get(back, "p", "c2", "8.11.2").first().status == 2
    assert cache.pending(df.select(*cache.PARTITIONS), back).isEmpty()
    assert {r.project: r.commits for r in cache.commits(back).collect()} == {"p": ["c1", "c2"], "q": ["c1", "c3"]}
    log = spark.createDataFrame([("p", "c1", "8.10.2", "build_error", None, "x"), ("p", "c1", "8.10.2", "timing", None, "y")], cache.EVENTS)
    assert [r.kind for r in cache.without_errors(log, df).collect()] == ["timing"]


def test_formats(spark, tmp_path):
    assert formats.infer_format("a/b.git.json.gz") == ("json", "gzip")
    assert formats.infer_format("x.yml") == ("yaml", None)
    with pytest.raises(ValueError):
        formats.infer_format("x.bin")
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak")], "i int, s string")
    for fmt, codec in (("jsonl", "gzip"), ("csv", None), ("parquet", None)):
        path = str(tmp_path / fmt)
        formats.write(df, path, fmt, codec)
        assert sorted(formats.read(spark, path, "i int, s string", fmt).collect()) == sorted(df.collect())
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "b"], "test": ["c"]}))
    assert sorted(map(tuple, formats.read_splits(spark, str(tmp_path / "split.json")).collect())) == [("test", "c"), ("train", "a"), ("train", "b")]
    assert formats.find_files(spark, str(tmp_path), "*.csv").count() >= 1
    files = spark.createDataFrame([("b.v",), ("a.v",), ("x/test/a.v",), ("test.v",)], "f string")
    assert [r.f for r in formats.source_files(files, "f", ["test"]).collect()] == ["a.v", "b.v", "x/test/a.v"]
    commands = spark.createDataFrame([("f", 2, "B."), ("f", 1, "A.")], "f string, i int, t string")
    assert formats.file_texts(commands, ["f"], "i", "t").first().contents == "A.\nB.\n"


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    df.write.parquet(src)

    def take():
        q = ingest.append_new(ingest.stream(spark, src, df.schema), out, ["k"], str(tmp_path / "cp"))
        q.awaitTermination(60)

    take()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    take()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    windows = ingest.windowed(events, "ts", ["event_type"], "value")
    assert windows.agg(F.sum("n")).first()[0] == events.count()
