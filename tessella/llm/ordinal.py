"""Quality classifier: ordinal cumulative-link regression over hashed text features.

Ratings are grades 0 < 1 < ... < G-1. All grades share one weight vector ``w`` over hashed
features, and ordered thresholds cut the score into grades:

    P(grade <= k) = sigmoid(theta[k] - w.x),    theta[0] < theta[1] < ...

The order is kept by fitting theta[0] and the logarithms of the gaps. A text's expected grade
is the sum of its tail probabilities P(grade >= k); selection is by one tail probability.

Features of a text are hashed from strings: each distinct lower-cased word (weight 1/sqrt(number
of them)), each distinct word's shape (letters, digits and signs run together; weight: its share
of the distinct words), and two texture strings (how far words repeat, how often a word repeats
the one before). The fit runs on the driver over at most ``SAMPLE`` rated documents, those whose
hashed ids come first; scoring reads whole texts, a row at a time, without a shuffle.

Defined cases: ratings or grades that are null teach nothing, a document rated twice counts with
its lowest grade, an id with several texts teaches one of them, always the same; with fewer than two grades to learn from nothing is rejected; a null, empty or
blank text has grade 0 for certain; very long texts are scored whole; rows may repeat; an empty
table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, tidy

SAMPLE = 10_000
DIMENSION = 1 << 18
STEPS = 120
RATE = 0.3
SHRINK = 1e-5
#: Documents stay if P(grade >= SELECT_GRADE) is at least SELECT_PROBABILITY.
SELECT_GRADE = 2
SELECT_PROBABILITY = 0.65
CACHE_WORDS = 200_000
#: Characters of text, and features of the sample, that are worked on at once.
TEXT_CHUNK = 1 << 19
FIT_CHUNK = 1 << 19
BATCH_BYTES = 8 << 20

_LETTERS, _DIGITS = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSION


class _Slots(dict):
    """Word -> slot of the word and slot of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        kind = "A" if word.isupper() and len(word) > 1 else "a"
        shape = _DIGITS.sub("9", _LETTERS.sub(kind, word))
        found = _slot("w:" + word.lower()) << 32 | _slot("s:" + shape)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


_slots = _Slots()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and weights of all texts in one row after another, and where each text begins (one more at the end)."""
    sets, counts, extra = [], [], []
    for text in texts:
        words = (text or "").split()
        own = set(words)
        sets.append(own)
        counts.append(len(own))
        if words:
            again = sum(map(str.__eq__, words, words[1:])) / len(words)
            extra.append((_slot(f"r:{int(10 * again)}"), _slot(f"u:{int(10 * len(own) / len(words))}:{len(words).bit_length()}")))
        else:
            extra.append((_slot("none"), _slot("none")))
    n = np.array(counts, dtype=np.int64)
    both = np.fromiter(chain.from_iterable(map(_slots.__getitem__, s) for s in sets), np.int64, int(n.sum()))
    share = 1.0 / np.maximum(n, 1)
    owner = np.repeat(np.arange(len(n)), n)
    rows = np.concatenate([owner, owner, np.repeat(np.arange(len(n)), 2)])
    slots = np.concatenate([both >> 32, both & 0xFFFFFFFF, np.array(extra, np.int64).reshape(-1)])
    values = np.concatenate([np.sqrt(share)[owner], share[owner], np.full(2 * len(n), 0.5)])
    order = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(2 * n + 2)])
    return slots[order].astype(np.int32), values[order].astype(np.float32), starts


def text_chunks(texts: list[str | None]) -> list[list[str | None]]:
    """Runs of texts of about TEXT_CHUNK characters."""
    out, used = [[]], 0
    for text in texts:
        n = len(text or "") + 64
        if used and used + n > TEXT_CHUNK:
            out.append([])
            used = 0
        out[-1].append(text)
        used += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class CumulativeLink:
    """Weights and thresholds of a fitted model; without weights all texts have the top grade."""

    def __init__(self, weights: np.ndarray | None, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row per text."""
        if self.weights is None:
            return np.ones((len(starts) - 1, len(self.thresholds)))
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots] * values, dtype=np.float64)])
        score = sums[starts[1:]] - sums[starts[:-1]]
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, texts: list[str | None]) -> np.ndarray:
        tails = np.concatenate([self.tails(*features(some)) for some in text_chunks(texts)])
        blank = np.array([not (t or "").strip() for t in texts], dtype=bool)
        tails[blank] = 0.0
        return tails


def fit(slots: np.ndarray, values: np.ndarray, starts: np.ndarray, grades: np.ndarray, n_grades: int) -> CumulativeLink:
    """Maximum likelihood with a little shrinkage, by Adam over all rows."""
    if len(np.unique(grades)) < 2:
        return CumulativeLink(None, np.zeros(max(0, n_grades - 1)))
    n = len(grades)
    # runs of documents of about FIT_CHUNK features bound the memory of a step
    cuts = np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + FIT_CHUNK, FIT_CHUNK)).clip(0, n)).tolist()
    if cuts[-1] != n:
        cuts.append(n)
    below = (np.bincount(grades, minlength=n_grades).cumsum()[:-1] + 0.5) / (n + 1)
    first = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    params = [np.zeros(DIMENSION), np.concatenate([first[:1], gaps])]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        w, t = params
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        slope_w, slope_cut = SHRINK * w, np.zeros(n_grades - 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, weight = slots[starts[a] : starts[b]], values[starts[a] : starts[b]]
            rows = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(starts[a : b + 1]))
            z, grade = np.bincount(rows, weights=w[own] * weight, minlength=b - a), grades[a:b]
            high, low = _sigmoid(cut[grade + 1] - z), _sigmoid(cut[grade] - z)
            p = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / p, low * (1 - low) / p
            slope_z = (up - down) / n  # of the negative log likelihood
            slope_cut += np.bincount(grade, weights=-up / n, minlength=n_grades)[:-1]
            slope_cut += np.bincount(grade, weights=down / n, minlength=n_grades)[1:]
            slope_w += np.bincount(own, weights=slope_z[rows] * weight, minlength=DIMENSION)
        tail = np.cumsum(slope_cut[::-1])[::-1]
        slopes = [
            slope_w,
            np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])]),
        ]
        for k, slope in enumerate(slopes):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            var[k] = 0.99 * var[k] + 0.01 * slope**2
            by = (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
            params[k] = params[k] - RATE * by
    w, t = params
    return CumulativeLink(w.astype(np.float32), np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades of the ratings table: 0 poor, 1 good but toxic, 2 good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def train(
    docs: DataFrame, graded: DataFrame, n_grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> CumulativeLink:
    """Fit on at most ``sample`` documents of ``graded`` (doc_id, grade)."""
    rated = graded.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    rated = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows: may be broadcast
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.filter(F.col("text").isNotNull()).join(F.broadcast(rated), "doc_id")

    def run(parts):
        for part in (p for whole in parts for p in pieces(whole, BATCH_BYTES)):
            cells = []
            for some in text_chunks(part.column("text").to_pylist()):
                slots, values, starts = features(some)
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own, back = np.unique(slots[a:b], return_inverse=True)  # slots come once: half as much to collect
                    sums = np.bincount(back, weights=values[a:b])
                    cells.append((own.tobytes(), sums.astype(np.float32).tobytes()))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "grade": part.column("grade"),
                    "slots": pa.array([c[0] for c in cells], pa.binary()),
                    "values": pa.array([c[1] for c in cells], pa.binary()),
                }
            )

    kind = dict(texts.dtypes)["doc_id"]
    made = texts.mapInArrow(run, f"doc_id {kind}, grade int, slots binary, values binary")
    # an id with several texts counts with the one whose features come first, whatever the rows' order
    first = made.groupBy("doc_id").agg(F.min(F.struct("slots", "values", "grade")).alias("f"))
    rows = first.select("doc_id", "f.grade", "f.slots", "f.values").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return CumulativeLink(None, np.zeros(n_grades - 1))
    slots = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("slots")), np.int32)
    values = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("values")), np.float32)
    starts = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // 4 for x in rows.column("slots")])])
    grades = rows.column("grade").to_numpy()
    del rows
    tidy()
    model = fit(slots, values, starts, grades, n_grades)
    del slots, values
    tidy()
    return model


def score(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, expected_grade, tail_prob, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(parts):
        own = shared.value
        for part in (p for whole in parts for p in pieces(whole, BATCH_BYTES)):
            tails = own.score(part.column(1).to_pylist())
            tail = tails[:, SELECT_GRADE - 1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= SELECT_PROBABILITY)],
                names=["doc_id", "expected_grade", "tail_prob", "kept"],
            )
        tidy()

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double, kept boolean")


def select(docs: DataFrame, model: CumulativeLink, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(parts):
        own = shared.value
        for part in (p for whole in parts for p in pieces(whole, BATCH_BYTES)):
            tails = own.score(part.column(place).to_pylist())
            yield part.filter(pa.array(tails[:, SELECT_GRADE - 1] >= SELECT_PROBABILITY))
        tidy()

    return docs.mapInArrow(run, docs.schema)
