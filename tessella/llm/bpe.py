"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word keeps its parts and, next to each part, the rank of the merge with its right-hand
neighbour in one flat array. The array is scanned for its minimum, that boundary is deleted and
the two neighbouring ranks are refreshed, until no merge is left. For short words such scans
beat any heap; words of over ``SHORT`` bytes use a heap over linked parts, as a scan per merge
would take quadratic time. Both take the lowest rank first, then the leftmost.

Encoded words are cached per worker, up to ``CACHE_WORDS`` of ``SHORT`` bytes at most.

Defined cases: a null text counts as empty and has no ids; the vocabulary's special tokens are
recognised within texts as the reference library does by default; bytes that do not decode
become U+FFFD; texts of any length are encoded whole; rows may repeat; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import filesystem, pieces

SHORT = 64
CACHE_WORDS = 500_000
BATCH_BYTES = 8 << 20
#: Fixed value: the pattern that splits text into words before merges.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NONE = 1 << 40


def byte_names() -> dict[int, str]:
    """Printable stand-in of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Ids of words; makes what is missing."""

    __slots__ = ("make",)

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        ids = tuple(self.make(data))
        if len(data) <= SHORT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        files, place = filesystem(path if "://" in path else f"file://{path}")
        with files.open_input_stream(place) as src:
            spec = json.loads(src.read())
        model, names = spec["model"], byte_names()
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in names.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.first = [vocab[names[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("special tokens that take in neighbours are not supported")
            self.bytes_of[token["id"]] = token["content"].encode()
        order = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, order)) + ")").split if order else None
        self.words = regex.compile(WORDS).findall
        self.cache = _Cache(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.first[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, top = self.merges.get, (_NONE, 0)
        found = [get(a << 32 | b, top) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best is top:
                break
            i = found.index(best)
            parts[i] = best[1]
            del parts[i + 1], found[i]
            if i < len(found):
                found[i] = get(best[1] << 32 | parts[i + 1], top)
            if i:
                found[i - 1] = get(parts[i - 1] << 32 | best[1], top)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = get(a << 32 | b)[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(parts[i] << 32 | parts[k]):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (m := get(parts[h] << 32 | parts[i])):
                heapq.heappush(heap, (m[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> array:
        """Ids of a text, as unsigned 32-bit numbers."""
        pieces = self.split(text) if self.split else [text]
        if len(pieces) == 1:
            return array("I", chain.from_iterable(map(self.cache.__getitem__, self.words(text))))
        ids = array("I")
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
            else:
                ids.extend(chain.from_iterable(map(self.cache.__getitem__, self.words(piece))))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def little_endian(ids: array) -> bytes:
    if ids.itemsize != 4:
        raise ValueError("unsigned int is not 32 bits wide here")
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids (array of int)."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(parts):
        own = codec(path)
        for part in parts:
            ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """A row per document: doc_id, text."""

    def run(parts):
        own = codec(path)
        for part in parts:
            texts = [own.decode(x or ()) for x in part.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": part.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]

    def run(parts):
        own = codec(path)
        for part in (p for whole in parts for p in pieces(whole, BATCH_BYTES)):
            counts, hashes, texts = [], [], []
            for text in part.column(1).to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(little_endian(ids)).hexdigest())
                texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
