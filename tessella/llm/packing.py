"""Order-preserving packing by dynamic programming over cut points.

Documents, each followed by an end-of-document id, form one stream per partition. Windows of
the stream become sequences; a window may end at a document's end (free), at a sentence's end
(a small penalty) or, inside sentences that are very long, at a forced cut (a large one). With
``f[j]`` the least cost of the stream up to cut point ``p[j]``,

    f[j] = penalty[j] + window + min(f[i] + pad(p[j] - p[i])),   p[j] - p[i] <= LENGTH

where ``pad(n)`` is ``LENGTH - n``, but 0 for a power of two. The first kind is the minimum of
``f[i] + p[i]`` over a sliding window, kept in a monotone queue; powers of two add the few
transitions from exactly ``p[j] - 2**q``. So a cut point costs constant time.

A partition is worked off in blocks of bounded size, or of one document if that is larger, which is
encoded and planned whole: the last windows of a block are held back and planned again together
with the next block. Nothing is shuffled; sequence numbers are
(partition, place).

Defined cases: a null text counts as empty and is its end id alone; texts of any length are cut
as needed; rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import WORDS, ByteBpe, codec
from .shared import pieces, tidy

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 2
FORCED_PENALTY = 16
#: Cost of a sequence of its own, so that small powers of two don't win by being free of padding.
WINDOW_COST = 64
#: Sentence ends closer than this to the cut point before are no cut points.
SPACING = 1
#: Longest run of tokens without a cut point.
FORCED_GAP = 128
BLOCK_TOKENS = 1 << 18
#: Bytes of texts that are taken from Arrow at once.
BATCH_BYTES = 8 << 20
#: Windows at a block's end that are planned again.
HELD_BACK = 4


class Encoder:
    """Ids of texts. The library's merge loop does it where ids rise with the ranks of merges.

    Then a merge by the rank of the merged bytes and one by the rank of the pair give the same
    parts; for any other vocabulary file the plain encoder is used.
    """

    def __init__(self, path: str) -> None:
        own: ByteBpe = codec(path)
        ids = [i for _, i in sorted(own.merges.values())]
        self.fast = None
        if all(a < b for a, b in zip(ids, ids[1:], strict=False)) and max(own.first) < min(ids, default=1 << 32):
            import tiktoken

            ranks = {own.bytes_of[i]: i for i in [*own.first, *ids]}
            if len(ranks) == len(own.first) + len(ids):
                pattern = WORDS.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
                self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=own.special)
        self.own = own
        ends = [b.rstrip(b" \"')").endswith((b".", b"!", b"?")) or b"\n" in b for b in own.bytes_of]
        self.ends_sentence = np.array(ends, dtype=bool)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.frombuffer(self.own.encode(text), dtype=np.uint32)
        return np.asarray(self.fast.encode(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(ends: np.ndarray, sentence: np.ndarray, spacing: int = SPACING, gap: int = FORCED_GAP):
    """Positions where a window may end, and their penalties.

    ``ends``: document ends, as positions; ``sentence``: whether each token ends a sentence.
    """
    free = np.zeros(len(sentence) + 1, dtype=bool)
    free[0] = True
    free[ends] = True
    found = np.flatnonzero(sentence) + 1
    # keep sentence ends with room since the last one; differences to the predecessor suffice
    room = np.diff(found, prepend=-spacing) >= spacing
    at = np.union1d(found[room], np.flatnonzero(free))
    jumps = np.diff(at)
    wide = np.flatnonzero(jumps > gap)
    if len(wide):
        extra = [np.arange(at[i] + gap, at[i + 1], gap) for i in wide]
        forced = np.concatenate(extra)
        at = np.union1d(at, forced)
        penalty = np.full(len(at), SENTENCE_PENALTY, dtype=np.int64)
        penalty[np.searchsorted(at, forced)] = FORCED_PENALTY
    else:
        penalty = np.full(len(at), SENTENCE_PENALTY, dtype=np.int64)
    penalty[free[at]] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``at`` where windows end, at the least total cost; the last is the stream's end."""
    m = len(at)
    total = int(at[-1])
    where = np.full(total + 1, -1, dtype=np.int64)
    where[at] = np.arange(m)
    exact: list[list[int]] = [[] for _ in range(m)]
    size = 1
    while size <= length:
        ok = np.flatnonzero(at >= size)
        back = where[at[ok] - size]
        for j, i in zip(ok[back >= 0].tolist(), back[back >= 0].tolist(), strict=True):
            exact[j].append(i)
        size *= 2
    p, pen = at.tolist(), penalty.tolist()
    f, came = [0] * m, [0] * m
    queue, values, head = [0], [0], 0  # indices, and f + p of each: rising
    for j in range(1, m):
        here = p[j]
        least = here - length
        while p[queue[head]] < least:
            head += 1
        i = queue[head]
        best = values[head] + length - here
        for k in exact[j]:
            if f[k] < best:
                best, i = f[k], k
        f[j] = best = best + pen[j] + WINDOW_COST
        came[j] = i
        value = best + here
        while len(values) > head and values[-1] >= value:
            values.pop()
            queue.pop()
        values.append(value)
        queue.append(j)
        if head > 65536:
            del queue[:head], values[:head]
            head = 0
    cuts, j = [], m - 1
    while j > 0:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs a stream of documents block by block."""

    def __init__(self, encoder: Encoder, first_sequence: int, length: int = LENGTH) -> None:
        self.encode, self.sequence, self.length = encoder, first_sequence, length
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # id, ids left, their start, tokens in all
        self.tokens = 0

    def add(self, doc_id, text: str) -> None:
        ids = np.append(self.encode(text), np.uint32(END_ID))
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows but those held back; of all if this is the end."""
        if not self.tokens:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        sizes = np.array([len(d[1]) for d in self.docs])
        ends = np.cumsum(sizes)
        at, penalty = cut_points(ends, self.encode.ends_sentence[ids], gap=min(FORCED_GAP, self.length))
        cuts = best_cuts(at, penalty, self.length)
        if not last:
            cuts = cuts[:-HELD_BACK]
            if not cuts:
                return []
        stops = at[cuts]
        done = int(stops[-1])
        starts = np.union1d(np.concatenate([[0], stops]), ends - sizes)
        starts = starts[starts < done]
        begins = np.concatenate([[0], stops])
        window = np.searchsorted(begins, starts, side="right") - 1
        doc = np.searchsorted(ends, starts, side="right")
        finish = np.append(starts[1:], done)
        data = ids.astype("<u4", copy=False)
        out = []
        for a, b, w, k in zip(starts.tolist(), finish.tolist(), window.tolist(), doc.tolist(), strict=True):
            doc_id, own, base, total = self.docs[k]
            crc = zlib.crc32(data[a:b].tobytes())
            out.append((doc_id, base + a - int(ends[k] - sizes[k]), b - a, crc, total, self.sequence + w, a - int(begins[w])))
        self.sequence += len(cuts)
        k = int(np.searchsorted(ends, done, side="right"))
        rest = self.docs[k:]
        if rest and (cut := done - int(ends[k] - sizes[k])):
            doc_id, own, base, total = rest[0]
            rest[0] = (doc_id, own[cut:], base + cut, total)
        self.docs, self.tokens = rest, int(ends[-1]) - done
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]

    def run(parts):
        packer = Packer(_encoder(path), TaskContext.get().partitionId() << 32)
        enough = max(block, 4 * HELD_BACK * LENGTH)
        id_type = None

        def rows(last):
            found = packer.flush(last)
            if found:
                cells = list(zip(*found, strict=True))
                columns = [pa.array(cells[0], id_type), *(pa.array(c, pa.int64()) for c in cells[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        for part in (p for whole in parts for p in pieces(whole, BATCH_BYTES)):
            id_type = part.schema.field(0).type
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc_id, text or "")
                if packer.tokens >= enough:
                    yield from rows(False)
        yield from rows(True)
        tidy()

    return base.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
