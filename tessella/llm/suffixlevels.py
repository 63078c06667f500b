"""Removal of repeated 200-byte passages with a logarithmic family of suffix arrays.

Every 200-byte window of a text has an *anchor*: of the ``HEAD``-byte strings in it the one with
the least hash, the leftmost if there are several. Equal windows have equal anchors at equal
offsets, so it is enough to sort the suffixes at anchors (one in some fifty bytes): a sparse
suffix array, ordered by the fingerprints of the suffixes' heads rather than alphabetically.

Texts are stored once, as numbered batches in the shared folder, and never shuffled. What moves
are arrays of fingerprints, dealt by value into ranges. The owner of a range takes the arrays
one batch after another into a ``LevelFamily``: the new array is merge-scanned against each
existing level, and levels of about equal size are merged, so that each entry is merged O(log n)
times. Rounds:

1. Heads and contexts. An anchor's context is all that a window with this anchor can reach (up
   to ``HEAD`` + 2 * (200 - ``HEAD``) bytes), known by a 128-bit BLAKE2 digest. An anchor whose
   context occurs twice is wholly covered. A head that occurs with different contexts may be part
   of a match in between.
2. Windows. For those heads each different context sends the fingerprints of its windows, once
   in all (and equal windows once a batch). A window whose fingerprint occurred before claims to be
   equal to the first one.
3. Proof. Neighbouring claims make spans. The batch of a claim sends the SHA-256 of the span's
   bytes, the batch of the first window compares it with that of its own bytes. Fingerprints only
   find candidates: spans that don't agree are taken apart, and their windows are grouped by
   their bytes.
4. Each batch takes the union of what is covered.

Equal entries of a batch are sent once, so a passage that a third of all rows share costs each
batch one entry. The number of ranges follows from the bytes of the texts, so ranges stay even.

Defined cases: a null text counts as empty; texts shorter than 200 bytes lose nothing; a text may be
as long as a row can be (it is a batch of its own, read in chunks); matches never cross documents;
rows that repeat are repeats of each other like any other text; an empty table gives an empty
result; ``remove_repeats`` passes other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, read_batch, spill_batches, tidy, written

MATCH = 200
HEAD = 100
BATCH_BYTES = 4 << 20
#: Bytes of text that fall to a range, and to a task that works on batches.
RANGE_BYTES = 8 << 20
TASK_BYTES = 16 << 20
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _U((1 << 24) - 1)
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_FLAG = np.uint32(1 << 31)
#: Digests of 16 bytes; as all have one length, the stripping of trailing zeros tells no two alike.
_DIGEST = np.dtype("S16")
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        row = np.full(max(n, CHUNK + 1024), base, dtype=np.uint64)
        row[0] = 1
        _powers[base] = np.cumprod(row, dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    rows = -(-n // width)
    block = np.full(rows * width, _TOP, dtype=np.uint64)
    block[:n] = values
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


class Buffer:
    """The texts of a batch as one byte array, and their bounds."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        column = texts.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        self.data = raw[first:last]
        bounds = (offsets - first) if len(column) else np.zeros(1, np.int64)
        self.starts, self.ends = bounds[:-1], bounds[1:]

    def chunks(self, match: int, head: int):
        """For each chunk of window starts: anchors, their head hashes and reach, and each valid
        window's start, anchor and hash function."""
        n, reach = len(self.data), match - head
        full = np.flatnonzero(self.ends > self.starts)
        if not len(full):
            return
        starts, ends = self.starts[full], self.ends[full]
        for a in range(0, n - match + 1, CHUNK):
            b = min(a + CHUNK, n - match + 1)
            lo, hi = max(0, a - reach), min(n, b + match + reach)
            raw = self.data[lo:hi].astype(np.uint64)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw + _U(1)) * _power(_BASE, len(raw)), out=sums[1:], dtype=np.uint64)
            undo = _power(_INVERSE, len(raw) + 1)

            def fingerprint(at, size, sums=sums, undo=undo, lo=lo):
                at = at - lo
                return _mix((sums[at + size] - sums[at]) * undo[at] + np.asarray(size).astype(np.uint64))

            last = min(b + reach, n - head + 1)
            place = np.arange(a, last)
            doc = np.searchsorted(starts, place, side="right") - 1
            end = ends[doc]
            heads = fingerprint(place, np.int64(head))
            order = np.where(place + head <= end, (heads & ~_PLACE) | (place - a).astype(np.uint64), _TOP)
            windows = place[: b - a]
            valid = windows + match <= end[: b - a]
            least = (_least(order, reach + 1)[: b - a] & _PLACE).astype(np.int64)
            windows, least = windows[valid], least[valid]
            if not len(windows):
                continue
            new = np.concatenate([[True], least[1:] != least[:-1]])
            local = least[new]
            anchors = local + a
            left = np.maximum(anchors - reach, starts[doc[local]])
            right = np.minimum(anchors + match, end[local])
            yield anchors, heads[local], left, right, windows, np.cumsum(new) - 1, fingerprint


class Anchors:
    """All anchors of a batch, with what the batch alone knows of them."""

    def __init__(self, buffer: Buffer, match: int, head: int) -> None:
        found = [x[:4] for x in buffer.chunks(match, head)]
        if found:
            place, heads, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
        else:
            place = left = right = np.zeros(0, np.int64)
            heads = np.zeros(0, np.uint64)
        once = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        self.place, self.left, self.right = place[once], left[once], right[once]
        # anchors have the least hashes of their windows: mixed again, they spread over all ranges
        heads = _mix(heads[once] ^ _U(_BASE))
        context = self._contexts(buffer.data)
        order = np.lexsort((context, heads))
        h, c = heads[order], context[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new_c = new_h | (np.concatenate([[True], c[1:] != c[:-1]]) if len(h) else new_h)
        in_h, in_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        size = np.bincount(in_c) if len(h) else np.zeros(0, np.int64)
        kinds = np.bincount(in_h[new_c]) if len(h) else np.zeros(0, np.int64)
        #: per different context: its first anchor, digest, whether it occurs again here, its head's number
        self.rep, self.context, self.again, self.head_of = order[new_c], c[new_c], size > 1, in_h[new_c]
        #: per different head: its first anchor, hash, whether it has several contexts here
        self.first, self.head, self.several = order[new_h], h[new_h], kinds > 1
        self.of = np.zeros(len(h), np.int64)
        self.of[order] = in_c

    def _contexts(self, data: np.ndarray) -> np.ndarray:
        """Digests of all contexts and of the anchors' places in them."""
        raw, digest = data.tobytes(), hashlib.blake2b
        found = [
            digest(raw[a:b], digest_size=16, salt=(p - a).to_bytes(2, "little")).digest()
            for p, a, b in zip(self.place.tolist(), self.left.tolist(), self.right.tolist(), strict=True)
        ]
        return np.frombuffer(b"".join(found), _DIGEST)


def _deal(keys: np.ndarray, values: np.ndarray, ranges: int):
    """Sort by key and cut into equal ranges of the key space."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    upper = keys >> _U(32) if keys.dtype == np.uint64 else keys.view(">u4")[::4].astype(np.uint64)
    number = (upper * _U(ranges)) >> _U(32)
    cuts = np.searchsorted(number, np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, keys[cuts[r] : cuts[r + 1]], values[cuts[r] : cuts[r + 1]]


class LevelFamily:
    """Sorted arrays of different keys, their sizes falling geometrically.

    ``add`` merge-scans a sorted array against all levels. ``firsts`` tells which entry brought a
    key first, ``result`` which entries have a match, and which are first.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.total = 0
        self._firsts: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        base, n = self.total, len(keys)
        self.total += n
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh, entry = keys[new], np.flatnonzero(new)
        first, known = entry + base, np.zeros(len(fresh), bool)
        for level, owners in self.levels:
            at = np.searchsorted(level, fresh)
            hit = np.flatnonzero(level[np.minimum(at, len(level) - 1)] == fresh)
            known[hit] = True
            first[hit] = owners[at[hit]]
        self._firsts.append(first[np.cumsum(new) - 1])
        level = (fresh[~known], first[~known])
        if not len(level[0]):
            return
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            other = self.levels.pop()
            keys = np.concatenate([other[0], level[0]])
            order = np.argsort(keys, kind="stable")
            level = (keys[order], np.concatenate([other[1], level[1]])[order])
        self.levels.append(level)

    def firsts(self) -> np.ndarray:
        """Of each entry, the number of the entry that brought its key."""
        return np.concatenate(self._firsts) if self._firsts else np.zeros(0, np.int64)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry, whether its key occurs again, and whether it owns its key."""
        firsts = self.firsts()
        owner = firsts == np.arange(self.total)
        seen = ~owner
        seen[firsts[~owner]] = True
        return seen, owner


HEADS, CONTEXTS, WINDOWS, BATCH, SETTLED, COVERED = 0, 1, 2, 3, 4, 5
_SENT = "kind int, range long, batch long, keys binary, entries binary"
_ANSWER = "kind int, batch long, entries binary"


def _sent(rows: list[tuple]) -> pa.Table:
    cells = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["kind", "range", "batch", "keys", "entries"])


def _answers(rows: list[tuple]) -> pa.Table:
    cells = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table(
        [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.binary())],
        names=["kind", "batch", "entries"],
    )


def _encoded(start: np.ndarray, batch: np.ndarray, first: np.ndarray) -> bytes:
    """Claims: the window at ``start`` equals that at ``first`` of ``batch``. Runs of them take little room."""
    start, batch, shift = start.astype(np.int64), batch.astype(np.int64), first.astype(np.int64) - start.astype(np.int64)
    order = np.lexsort((start, shift, batch))
    raw = b"".join(np.diff(x[order], prepend=0).astype(np.int64).tobytes() for x in (start, shift, batch))
    return len(start).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, shifts to the first windows and those windows' batches."""
    parts = []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = np.frombuffer(pa.decompress(blob[8:], n * 24, codec="zstd", asbytes=True), np.int64).reshape(3, n)
        parts.append(np.cumsum(raw, axis=1))
    start, shift, batch = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    return start, shift, batch


def _own(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Work of the owner of a range: the batches' arrays, one after another, into a level family.

    Answers: the entries of a batch that have a match; of contexts the flag says that the entry
    stands for its context from now on; of windows the claims.
    """
    kind = key[0].as_py()
    batches = table.column("batch").to_pylist()
    if kind in (BATCH, SETTLED, COVERED):
        known = WINDOWS if kind == SETTLED else kind
        return _answers([(known, b, e) for b, e in zip(batches, table.column("entries").to_pylist(), strict=True)])
    order = np.argsort(np.array(batches), kind="stable").tolist()
    family, entries = LevelFamily(), []
    keys, values = table.column("keys"), table.column("entries")
    for i in order:
        family.add(np.frombuffer(keys[i].as_py(), _DIGEST if kind == CONTEXTS else np.uint64))
        entries.append(np.frombuffer(values[i].as_py(), np.uint32))
    seen, owner = family.result()
    rows, at = [], 0
    if kind == WINDOWS:
        firsts, every = family.firsts(), np.concatenate(entries)
        sender = np.repeat(np.array(batches, np.int64)[order], [len(e) for e in entries])
    for i, own in zip(order, entries, strict=True):
        here = slice(at, at + len(own))
        at += len(own)
        if kind == WINDOWS:
            late = ~owner[here]
            if late.any():
                first = firsts[here][late]
                rows.append((kind, batches[i], _encoded(own[late], sender[first], every[first])))
            continue
        if kind == CONTEXTS:
            found = (own[seen[here]] & ~_FLAG) | np.where(owner[here][seen[here]], _FLAG, np.uint32(0))
        else:
            found = own[seen[here] & (own & _FLAG == 0)]  # flagged entries want no answer
        if len(found):
            rows.append((kind, batches[i], found.astype(np.uint32).tobytes()))
    tidy()
    return _answers(rows)


class _Known:
    """A batch with the answers to its entries."""

    def __init__(self, folder: str, table: pa.Table, text: str, match: int, head: int) -> None:
        self.number = table.column("batch")[0].as_py()
        self.rows = read_batch(folder, self.number)
        self.buffer = Buffer(self.rows.column(text))
        self.anchors = Anchors(self.buffer, match, head)
        got: dict[int, list[np.ndarray]] = {HEADS: [], CONTEXTS: []}
        for kind, entries in zip(table.column("kind").to_pylist(), table.column("entries").to_pylist(), strict=True):
            if kind != BATCH:
                got[kind].append(np.frombuffer(entries, np.uint32))
        self.got = {k: np.concatenate(v).astype(np.uint32) if v else np.zeros(0, np.uint32) for k, v in got.items()}
        a = self.anchors
        found = self.got[CONTEXTS]
        self.elsewhere = np.zeros(len(a.rep), bool)
        self.elsewhere[found & ~_FLAG] = True
        self.stands = np.zeros(len(a.rep), bool)
        self.stands[found[found & _FLAG != 0] & ~_FLAG] = True
        self.stands |= ~self.elsewhere
        self.covered = a.again | self.elsewhere
        self.mixed = a.several.copy()
        self.mixed[self.got[HEADS]] = True


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of intervals, as rows (start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(start) else new
    return np.stack([start[new], end[last]], axis=1).astype(np.int64)


def _send_windows(folder: str, text: str, match: int, head: int, ranges: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known = _Known(folder, table, text, match, head)
        a = known.anchors
        whole = known.covered[a.of] if len(a.of) else np.zeros(0, bool)
        rows = [(COVERED, known.number, known.number, b"", _merged(a.left[whole], a.right[whole]).tobytes())]
        place = np.sort(a.place[a.rep[known.mixed[a.head_of] & known.stands]])
        hashes, starts = [], []
        if len(place):
            for anchors, _, _, _, windows, of, fingerprint in known.buffer.chunks(match, head):
                at = np.minimum(np.searchsorted(place, anchors), len(place) - 1)
                start = windows[(place[at] == anchors)[of]]
                if len(start):
                    hashes.append(fingerprint(start, np.int64(match)) >> _U(64 - bits) << _U(64 - bits))
                    starts.append(start.astype(np.uint32))
        if hashes:
            hashed, start = np.concatenate(hashes), np.concatenate(starts)
            order = np.argsort(hashed, kind="stable")
            hashed, start = hashed[order], start[order]
            new = np.concatenate([[True], hashed[1:] != hashed[:-1]])
            if not new.all():  # windows that repeat within the batch claim to equal its first one
                first = start[new][np.cumsum(new) - 1]
                here = _encoded(start[~new], np.full(int((~new).sum()), known.number), first[~new])
                rows.append((SETTLED, known.number, known.number, b"", here))
            for r, keys, values in _deal(hashed[new], start[new], ranges):
                rows.append((WINDOWS, r, known.number, keys.tobytes(), values.tobytes()))
        tidy()
        return _sent(rows)

    return run


_SPAN = pa.schema([("batch", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("first", pa.int64()), ("first_start", pa.int64()), ("sha", pa.binary())])


def _texts_of(folder: str, number: int, text: str) -> Buffer:
    return Buffer(read_batch(folder, number).column(text))


def _claimed(folder: str, text: str, match: int):
    """Neighbouring claims of a batch as spans, with the digest of their bytes."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        start, shift, batch = _decoded(table.column("entries").to_pylist())
        order = np.lexsort((start, shift, batch))
        start, shift, batch = start[order], shift[order], batch[order]
        new = np.ones(len(start), bool)
        new[1:] = (batch[1:] != batch[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] - start[:-1] > match)
        end = start[np.concatenate([new[1:], [True]])] + match
        start, shift, batch = start[new], shift[new], batch[new]
        data = _texts_of(folder, number, text).data
        sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        tidy()
        cells = [np.full(len(start), number, np.int64), start, end - start, batch, start + shift]
        return pa.table([*(pa.array(c) for c in cells), pa.array(sha, pa.binary())], schema=_SPAN)

    return run


def _refuted(folder: str, text: str):
    """Spans whose bytes aren't those of the first windows, which lie in this batch."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = _texts_of(folder, key[0].as_py(), text).data
        at, n = table.column("first_start").to_pylist(), table.column("length").to_pylist()
        wrong = [
            hashlib.sha256(data[a : a + k]).digest() != sha for a, k, sha in zip(at, n, table.column("sha").to_pylist(), strict=True)
        ]
        tidy()
        return table.filter(pa.array(wrong, pa.bool_()))

    return run


def _windows_of(folder: str, text: str, match: int):
    """All windows of spans of a batch, with their bytes."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        data = _texts_of(folder, number, text).data
        spans = zip(table.column("start").to_pylist(), table.column("length").to_pylist(), strict=True)
        starts = sorted({x for a, n in spans for x in range(a, a + n - match + 1)})
        cells = [pa.array([number] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([data[x : x + match].tobytes() for x in starts], pa.binary())]
        return pa.table(cells, names=["batch", "start", "bytes"])

    return run


def _proven(claims: DataFrame, folder: str, text: str, match: int, tasks: int) -> DataFrame:
    """Spans (batch, start, length) that are covered: claims that hold, on both sides."""
    spans = claims.repartition(tasks, "batch").groupBy("batch").applyInArrow(
        _claimed(folder, text, match), "batch long, start long, length long, first long, first_start long, sha binary"
    )
    spans = written(spans, "suffix-spans")
    proof = ["first", "first_start", "length", "sha"]
    schema = "first long, first_start long, length long, sha binary"
    refuted = spans.select(proof).distinct().repartition(tasks, "first").groupBy("first").applyInArrow(_refuted(folder, text), schema)
    refuted = written(refuted, "suffix-refuted")
    doubtful = None
    if not refuted.isEmpty():
        doubtful = spans.join(refuted, proof, "left_semi")
        spans = spans.join(refuted, proof, "left_anti")
    firsts = ["first as batch", "first_start as start", "length"]
    covered = spans.select("batch", "start", "length").unionByName(spans.selectExpr(*firsts).distinct())
    if doubtful is None:
        return covered
    both = doubtful.select("batch", "start", "length").unionByName(doubtful.selectExpr(*firsts)).distinct()
    windows = both.groupBy("batch").applyInArrow(_windows_of(folder, text, match), "batch long, start long, bytes binary")
    windows = written(windows, "suffix-windows")
    again = windows.groupBy("bytes").count().filter("count > 1")
    equal = windows.join(again.select("bytes"), "bytes", "left_semi")
    return covered.unionByName(equal.select("batch", "start", F.lit(match).cast("long").alias("length")))


class _Covered:
    """A batch and which of its bytes are covered; per document how many and in how many runs."""

    def __init__(self, folder: str, table: pa.Table, text: str) -> None:
        self.rows = read_batch(folder, table.column("batch")[0].as_py())
        self.buffer = Buffer(self.rows.column(text))
        depth = np.zeros(len(self.buffer.data) + 1, np.int32)
        wholes = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("entries").drop_null().to_pylist()]
        marks = table.filter(table.column("start").is_valid())
        start, length = marks.column("start").to_numpy(), marks.column("length").to_numpy()
        for a, b in [*((w[:, 0], w[:, 1]) for w in wholes), (start, start + length)]:
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
        self.marks = np.cumsum(depth)[:-1] > 0
        starts, ends = self.buffer.starts, self.buffer.ends
        runs = self.marks.copy()
        runs[1:] &= ~self.marks[:-1]
        inner = starts[(starts < ends)]
        runs[inner] = self.marks[inner]
        sums = np.zeros(len(self.marks) + 1, np.int64)
        np.cumsum(self.marks, out=sums[1:])
        self.removed = sums[ends] - sums[starts]
        np.cumsum(runs, out=sums[1:])
        self.runs = sums[ends] - sums[starts]

    def left(self, i: int) -> bytes:
        """What is left of a document."""
        a, b = int(self.buffer.starts[i]), int(self.buffer.ends[i])
        data = self.buffer.data[a:b]
        return (data[~self.marks[a:b]] if self.removed[i] else data).tobytes()


def _answered(sent: DataFrame, tasks: int) -> DataFrame:
    """The owners' answers to what the batches sent, as a written table."""
    dealt = sent.repartition(tasks, "kind", "range").groupBy("kind", "range")
    return written(dealt.applyInArrow(_own, _ANSWER), "suffix-answers")


def _find(docs: DataFrame, text: str, match: int, head: int, batch_bytes: int, bits: int) -> tuple[str, DataFrame]:
    """Store the rows as batches; their folder and what is covered, at least one row per batch."""
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix-batches")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-total // RANGE_BYTES))
    # a stated number of tasks, in proportion to the texts: adaptive execution doesn't merge them, and
    # no task gets more ranges or batches as the input grows
    tasks = max(least, -(-total // TASK_BYTES))

    def send(rows: pa.Table, number: int):
        a = Anchors(Buffer(rows.column(text)), match, head)
        out = [(BATCH, number, number, b"", b"")]
        numbers = np.arange(len(a.rep), dtype=np.uint32)
        for r, keys, values in _deal(a.context, numbers | np.where(a.again, _FLAG, np.uint32(0)), ranges):
            out.append((CONTEXTS, r, number, keys.tobytes(), values.tobytes()))
        numbers = np.arange(len(a.first), dtype=np.uint32)
        for r, keys, values in _deal(a.head, numbers | np.where(a.several, _FLAG, np.uint32(0)), ranges):
            out.append((HEADS, r, number, keys.tobytes(), values.tobytes()))
        yield from _sent(out).to_batches()

    sent = docs.mapInArrow(spill_batches(folder, batch_bytes, send), _SENT)
    first = _answered(sent, tasks)
    windows = first.repartition(tasks, "batch").groupBy("batch").applyInArrow(_send_windows(folder, text, match, head, ranges, bits), _SENT)
    second = _answered(windows, tasks)
    proven = _proven(second.filter(F.col("kind") == WINDOWS).select("batch", "entries"), folder, text, match, tasks)
    none = F.lit(None)
    whole = second.filter(F.col("kind") == COVERED).select(
        "batch", none.cast("long").alias("start"), none.cast("long").alias("length"), "entries"
    )
    return folder, whole.unionByName(proven.withColumn("entries", none.cast("binary"))).repartition(tasks, "batch")


def repeated_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    match: int = MATCH,
    head: int = HEAD,
    batch_bytes: int = BATCH_BYTES,
    bits: int = 64,
) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``bits`` of windows' fingerprints are used; fewer make more candidates, results are the same.
    """
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    folder, covered = _find(base, "text", match, head, batch_bytes, bits)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known = _Covered(folder, table, "text")
        hashes = [hashlib.sha256(known.left(i)).hexdigest() for i in range(len(known.removed))]
        tidy()
        return pa.table(
            {
                "doc_id": known.rows.column("doc_id"),
                "n_bytes": pa.array(known.buffer.ends - known.buffer.starts, pa.int64()),
                "n_removed": pa.array(known.removed, pa.int64()),
                "n_spans": pa.array(known.runs, pa.int64()),
                "kept_sha256": pa.array(hashes, pa.string()),
            }
        )

    kind = dict(base.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return covered.groupBy("batch").applyInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, text_col: str = "text", match: int = MATCH, head: int = HEAD, batch_bytes: int = BATCH_BYTES, bits: int = 64
) -> DataFrame:
    """``docs`` without the covered bytes of its texts, all columns kept.

    Bytes of a character that was covered in part are dropped; a null text stays null.
    """
    columns = docs.columns
    place = columns.index(text_col)
    base = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{place}"
    folder, covered = _find(base, text, match, head, batch_bytes, bits)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known = _Covered(folder, table, text)
        old = known.rows.column(text).to_pylist()
        for i in np.flatnonzero(known.removed).tolist():
            old[i] = known.left(i).decode("utf-8", "ignore")
        tidy()
        return known.rows.set_column(place, text, pa.array(old, pa.string()))

    return covered.groupBy("batch").applyInArrow(run, base.schema).toDF(*columns)
