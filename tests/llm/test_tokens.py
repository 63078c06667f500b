"""BPE and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2028\u3000abcdefgXYZ0129'\".,!?é漢字🙂\u0301\u200b<|>ßİ½²"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@given(st.lists(st.one_of(st.text(ALPHABET, max_size=12), st.text(max_size=4), st.sampled_from(["<|endoftext|>", "'ll", "a" * 70, "  \n"])), max_size=12))
@settings(max_examples=300, deadline=None)
def test_same_as_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    t = Tokenizer.from_file(PATH) if not hasattr(test_same_as_library, "t") else test_same_as_library.t
    test_same_as_library.t = t
    own, fast = bpe.codec(PATH), packing._encoder(PATH)
    want = t.encode(text, add_special_tokens=False).ids
    assert list(own.encode(text)) == want
    assert fast.fast is not None and fast(text).tolist() == want
    assert own.decode(want) == t.decode(want, skip_special_tokens=False)
    half = want[: len(want) // 2 + 1]
    assert own.decode(half) == t.decode(half, skip_special_tokens=False)


def test_long_words(library):
    for text in ("a" * 5000, "xyz" * 3000, "漢" * 2000, "ab" * 31, " " * 4000):
        assert list(bpe.codec(PATH).encode(text)) == library.encode(text, add_special_tokens=False).ids


TEXTS = [None, "", "a", "One. Two! Three?\nFour " * 700, "word" * 9000, "Hello <|endoftext|> there.", "x" * 100_000, "é. " * 3000]


def test_round_trip(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).collect()}
    assert again == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_packing(spark, library, block):
    rng = random.Random(4)
    texts = TEXTS + [" ".join("ab."[rng.randrange(3)] for _ in range(rng.randint(0, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(2)
    rows = packing.pack(df, PATH, block=block).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.1 * total


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        at = np.unique(np.concatenate([[0], rng.integers(1, 60, 12)]))
        at = np.unique(np.concatenate([at, np.arange(0, at[-1], 8)]))
        penalty = rng.integers(0, 9, len(at))
        cuts = packing.best_cuts(at, penalty, 16)
        f = [0.0] * len(at)
        for j in range(1, len(at)):
            f[j] = min(
                f[i] + penalty[j] + packing.WINDOW_COST + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else 16 - n)
                for i in range(j)
                if at[j] - at[i] <= 16
            )
        cost, last = 0, 0
        for j in cuts:
            n = at[j] - at[last]
            assert 0 < n <= 16
            cost += penalty[j] + packing.WINDOW_COST + (0 if n & (n - 1) == 0 else 16 - n)
            last = j
        assert last == len(at) - 1 and cost == f[-1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0 and bpe.round_trip(df, PATH).count() == 0


def test_repeated_and_long_rows(spark, library):
    """Repeated rows are packed and encoded each; a long text is encoded whole."""
    long = "word, and another. " * 60_000
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, long), (None, None)], "doc_id long, text string")
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.round_trip(df, PATH).collect()) == [("1", 2), ("1", 2), ("2", n), ("None", 0)]
    rows = packing.pack(df, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 6 and sum(r.length for r in rows if r.doc_id == 2) == n + 1
    assert sum(r.length for r in rows if r.doc_id is None) == 1
