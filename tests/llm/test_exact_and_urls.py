"""Exact dedup, URL filter and WARC against plain Python, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import exacthash, urltrie, warc
from tessella.llm.queries import URL_RULES


def same(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


DOCS = [(1, "a b"), (2, "ab "), (3, "a  b "), (4, None), (5, ""), (6, " \t"), (7, "x\u00a0y"), (8, "xy"), (9, "é"), (9, "é"), (10, "long " * 9000), (11, "long" * 9000), (None, "ab")]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in DOCS], "doc_id long, text string, kept string, h int, norm int").repartition(3)
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[same(t)].append((i, t or ""))
    best = {k: min(v, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0] for k, v in groups.items()}
    for rows in (1, 512):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in exacthash.exact_dedup(df, bucket_rows=rows).collect())
        want = sorted((str(i), str(best[same(t)]), len(groups[same(t)]), hashlib.sha256(same(t).encode()).hexdigest()) for i, t in DOCS)
        assert got == want
    kept = {r.doc_id for r in exacthash.exact_dedup(df).filter("kept").collect()}
    assert kept == {best[k] for k in groups}
    stay = exacthash.drop_copies(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(best.values())  # repeated rows of 9 leave one


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_exact_dedup_ids(spark, kind):
    """Extreme, null and textual ids."""
    top = 2**63 - 1 if kind == "long" else 2**31 - 1
    ids = [top, -top - 1, -top, 0, None] if kind != "string" else ["b", "a", "", None, "ab"]
    rows = [(i, t) for t in ("x", "y ", "z" * 40) for i in ids] + [(ids[0], "only")] + [(None, "none"), (None, "n one"), (None, "n one")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    best = {}
    for i, t in rows:
        rank = (-len(t), i is None, i or (0 if kind != "string" else ""))
        best[same(t)] = min(best.get(same(t), ((1,), None)), (rank, i), key=lambda x: x[0])
    got = exacthash.exact_dedup(df).collect()
    assert {(r.text_sha256, r.keep_id) for r in got} == {(hashlib.sha256(k.encode()).hexdigest(), v[1]) for k, v in best.items()}
    stay = exacthash.drop_copies(df).collect()
    assert sorted(same(r.text) for r in stay) == sorted(best)
    assert {same(r.text): r.doc_id for r in stay} == {k: v[1] for k, v in best.items()}


def test_exact_dedup_collisions(spark, monkeypatch):
    """Different texts of one hash become links of a chain: their bytes are compared."""
    monkeypatch.setattr(exacthash.F, "xxhash64", lambda *c: exacthash.F.lit(7).cast("long") if len(c) == 1 else exacthash.F.hash(*c).cast("long"))
    df = spark.createDataFrame([(i, "abcde"[i % 5] * (1 + i % 2)) for i in range(40)], "doc_id long, text string").repartition(3)
    got = exacthash.exact_dedup(df).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 10, 4) for i in range(40)}
    assert {(r.bucket, r.link) for r in got} == {(got[0].bucket, k) for k in range(1, 11)}
    assert sorted(r.doc_id for r in exacthash.drop_copies(df).collect()) == list(range(10))


def test_exact_dedup_pages(spark, monkeypatch):
    """A directory that can't double any more leaves its buckets several pages."""
    monkeypatch.setattr(exacthash, "MAX_DEPTH", 1)
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(100)], "doc_id long, text string")
    got = exacthash.exact_dedup(df, bucket_rows=4).collect()
    assert all(r.keep_id == r.doc_id % 50 and r.group_size == 2 for r in got)
    assert len({r.bucket for r in got}) == 2 and max(r.page for r in got) >= 6


def test_exact_dedup_needs_its_index(spark, monkeypatch):
    """Results come from the chains: without one of their rows, its documents have no class."""
    whole = exacthash.Index._paged
    monkeypatch.setattr(exacthash.Index, "_paged", lambda self, chains, n: whole(self, chains, n).filter("n < 3"))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exacthash.exact_dedup(df).collect()} == {1: None, 2: None, 3: None, 4: 4}


def test_exact_dedup_long(spark):
    rows = [(1, "x y" * 2_000_000), (2, "xy" * 2_000_000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exacthash.exact_dedup(df).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_exact_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exacthash.exact_dedup(df).count() == 0
    assert exacthash.drop_copies(df).count() == 0


@given(st.lists(st.integers(0, 15), max_size=200), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_directory(cells, capacity):
    counts = {c: cells.count(c) for c in set(cells)}
    d = exacthash.Directory.fitted(counts, 4, capacity)
    assert len(d.slots) == 1 << d.depth <= 16
    width = 16 >> d.depth
    held = defaultdict(int)
    for c in cells:
        held[d.slots[c // width]] += 1
    for b, n in held.items():
        assert n <= capacity or d.local[b] == 4
    for b in set(d.slots):  # a bucket of local depth l owns 2**(depth - l) neighbouring slots
        own = [i for i, x in enumerate(d.slots) if x == b]
        assert own == list(range(own[0], own[0] + (1 << (d.depth - d.local[b]))))


def judged(url):
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    rest = re.match("[^?#]*", rest)[0] if rest else ""
    host, slash, tail = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + tail
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://x.NET/", "http://x.net", "https://a.example.net/en/1?x=/de/#y", "http://example.net/en", "http://notexample.net/en/2",
    "http://example.com/de/", "http://w.example.com/de/q://z", "http://example.org/fr/1", "http://org/fr/", "http://xorg/fr/", "http://É.net/", "a://b.net?c/d",
    "http://.net/", "http://a..net/", "http://net:80/", "http://x.net//en/",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = urltrie.judge_urls(df, URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id])


host_text = st.text(alphabet="ab.n", max_size=6)
path_text = st.text(alphabet="/ab", max_size=6)


@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), host_text.filter(bool), path_text), max_size=6), host_text, path_text)
@settings(max_examples=300, deadline=None)
def test_trie(rules, host, path):
    fits = [(h.count(".") + 1, len(h), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    got = urltrie.UrlTrie(rules).match(host, path)
    assert got == (best and (best[4], best[5]))


PAGES = [(1, "http://a", "<p>é"), (2, None, None), (3, "u\r\nv", ""), (4, "x", "<p>é"), (5, "y", "z" * 200_000), (5, "y", "z" * 200_000), (None, "n", "<p>é"), (7, "q", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 1])
def test_warc(spark, least):
    df = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload int").repartition(2)
    folder = warc.new_folder(spark, "test-warc")
    manifest = warc.write_warc(df, folder, min_revisit_bytes=least, archive_bytes=100)
    assert manifest.count() >= 3
    got = warc.read_warc(manifest, payloads=True).collect()
    assert len(got) == len(PAGES)
    data = [(i, (h or "").encode()) for i, _, h in PAGES]
    owner = {d: max((i for i, e in data if e == d and i is not None), default=None) for _, d in data}
    want = []
    for i, d in data:
        again = i != owner[d] and len(d) >= least
        digest = base64.b32encode(hashlib.sha1(d).digest()).decode()
        want.append((str(i), len(d), digest, "revisit" if again else "response", str(owner[d] if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    for r in got:
        if r.record_type == "response":
            assert r.payload in {d for i, d in data if i == r.page_id}


def test_warc_reader_finds_damage():
    good = warc.encode_record(1, "u", b"abc") + warc.encode_record(2, None, b"x" * 5000)
    rows = list(warc.read_archive(io.BytesIO(good), "a", True))
    assert [(r["page_id"], r["payload"]) for r in rows] == [(1, b"abc"), (2, b"x" * 5000)]
    assert [m for _, m in warc.read_members(io.BytesIO(good), chunk=7)] == [m for _, m in warc.read_members(io.BytesIO(good))]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(good[:-3]), "a"))
    import gzip

    raw = gzip.decompress(warc.encode_record(1, "u", b"abc"))
    for bad in (raw.replace(b"abc", b"abd"), raw.replace(b"Content-Length: 8", b"Content-Length: 9"), raw[:-1]):
        if bad != raw:
            with pytest.raises(ValueError):
                list(warc.read_archive(io.BytesIO(gzip.compress(bad)), "a"))


def member(kind, block, *more, version="1.0", cut=0):
    import gzip

    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block) - cut}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_standard_records():
    """Records of other writers: no digests, other ids, types and algorithms, folded and odd headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    sha256 = "sha256:" + hashlib.sha256(b"<p>hi").hexdigest()
    uuid = "WARC-Record-ID: <urn:uuid:d7ae5c10-e6b3-4d27-967d-34780c58ba39>"
    data = [
        member("warcinfo", b"software: x\r\n", uuid, "Content-Type: application/warc-fields"),
        member("request", b"GET / HTTP/1.1\r\n\r\n", uuid, "Content-Type: application/http; msgtype=request"),
        member("response", http, uuid, "content-type: application/http;msgtype=response", "WARC-Target-URI: http://a/\r\n b", f"WARC-Payload-Digest: {sha256}"),
        member("resource", b"", uuid, "WARC-Block-Digest: md9:zzz", version="1.1"),
        member("revisit", b"HTTP/1.1 304\r\n\r\n", uuid, "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:0>", "WARC-Payload-Digest: sha1:ABC"),
        member("response", b"HTTP/1.1 200 OK", "Content-Type: application/http"),
    ]
    rows = list(warc.read_archive(io.BytesIO(b"".join(data)), "a", True))
    assert [r["record_type"] for r in rows] == ["warcinfo", "request", "response", "resource", "revisit", "response"]
    assert rows[2]["payload"] == b"<p>hi" and rows[2]["payload_bytes"] == 5 and rows[2]["url"] == "http://a/ b"
    assert rows[2]["payload_digest"] == base64.b32encode(hashlib.sha1(b"<p>hi").digest()).decode()
    assert rows[4]["payload_digest"] == "ABC" and rows[4]["refers_to"] is None and rows[5]["payload"] == b""
    assert all(r["page_id"] is None for r in rows) and rows[0]["record_id"].startswith("<urn:uuid:")
    for bad in (
        member("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:ABC"),
        member("resource", b"x", "WARC-Block-Digest: sha1:ABC"),
        member("resource", b"xy", cut=1),
        member("resource", b"xy", cut=-1),
    ):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(bad), "a"))


def test_warc_bomb():
    """What a member holds beyond its record is never unpacked."""
    import gzip
    import tracemalloc

    bomb = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc" + bytes(300 << 20), 9)
    endless = gzip.compress(b"WARC/1.0\r\nX: " + b"x" * (300 << 20), 9)
    tracemalloc.start()
    for data in (bomb, endless):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(data), "a"))
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_warc_reads_side_by_side(spark):
    df = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html")).repartition(3)
    manifest = warc.write_warc(df, warc.new_folder(spark, "test-warc"), archive_bytes=100)
    read = warc.read_warc(manifest)
    assert manifest.count() >= 30 and read.count() == 60
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() >= 6


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def test_urls_empty_and_long(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "net/" + "x/" * 50_000), (2, "http://example.net/en/" + "y" * 10**6)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urltrie.judge_urls(df, URL_RULES).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow")}
    assert urltrie.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_many_rules_on_one_host():
    """Beginnings of a segment are looked up by length, not one after another."""
    import time

    trie = urltrie.UrlTrie([("block", "a.org", f"/p{i}") for i in range(100_000)])
    begun = time.perf_counter()
    assert all(trie.match("a.org", f"/p{i}x") == (f"a.org/p{i}", "block") for i in range(0, 100_000, 50))
    assert time.perf_counter() - begun < 1
