"""Language identification with a bit-sliced Bloom filter over n-grams.

One filter serves all languages: each slot holds a bit mask with one bit per language. The
conjunction of an n-gram's slots is the set of all languages that (may) contain it. Per text
and language the bits are counted; the share of n-grams that a filter as full as the language's
slice would report by chance is taken off, and the largest count decides.

N-grams are four bytes of the lower-cased UTF-8 text, with everything in ASCII but letters
folded to spaces. All training texts are counted; a language contains an n-gram if its rate
there is at least ``MIN_RATE`` and within a factor ``SHARE`` of the n-gram's best rate. The
filter's size is fixed, so it may be broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if there is nothing to learn from; a null language teaches nothing; a null id counts as
not held out; ties go to the language first in order; a text whose n-grams are all unknown gets
the language with most training n-grams and score 0; texts of any length are read whole, in chunks;
rows that repeat count as often as they stand there; an empty table gives an empty result; other
columns are ignored. Over ``MAX_LANGUAGES`` different languages are an error: it bounds the filter
(8 MB for each 64 languages), which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, written

FILTER_BITS = 20
HASHES = 3
MIN_RATE = 2e-6
SHARE = 3.0
MAX_LANGUAGES = 4096
CHUNK = 2 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a buffer's four-byte grams, and their places; grams with two spaces in a row are left out."""
    b = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    space = b == 32
    two = space[:-1] & space[1:]
    place = np.flatnonzero(~(two[:-2] | two[1:-1] | two[2:]))
    w = b.astype(np.uint32)
    code = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
    return code[place], place


def slots_of(codes: np.ndarray, bits: int = FILTER_BITS) -> list[np.ndarray]:
    """The filter slots of each gram."""
    x = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << bits) - 1)
    return [((x >> np.uint64(21 * i)) & low).astype(np.int64) for i in range(HASHES)]


def _chunks(texts: list[str | None]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of about CHUNK bytes, and (text, start, end) of what they hold; long texts go on in the next."""
    parts: list[bytes] = []
    spans: list[tuple[int, int, int]] = []
    used = 0
    for k, text in enumerate(texts):
        if text is None:
            continue
        data = b" " + text.lower().encode() + b" "
        for at in range(0, max(1, len(data) - 3), CHUNK):
            piece = data[at : at + CHUNK + 3]
            spans.append((k, used, used + len(piece)))
            parts.append(piece)
            parts.append(b"  ")  # no gram that counts lies across texts
            used += len(piece) + 2
            if used >= CHUNK:
                yield b"".join(parts), spans
                parts, spans, used = [], [], 0
    if parts:
        yield b"".join(parts), spans


def _add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two counts by sorted key."""
    keys, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([a[1], b[1]]), minlength=len(keys)).astype(np.int64)


def count_grams(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, lang, n) over all rows of (lang, text); each task adds up before the shuffle."""
    index = {name: i for i, name in enumerate(languages)}

    def run(parts):
        total = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for part in (p for whole in parts for p in pieces(whole, 4 * CHUNK)):
            names, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for data, spans in _chunks(texts):
                codes, place = grams(data)
                ends = np.array([e for _, _, e in spans])
                owner = np.array([index[names[k]] for k, _, _ in spans], dtype=np.uint64)
                tag = owner[np.minimum(np.searchsorted(ends, place, side="right"), len(owner) - 1)]
                keys, n = np.unique((tag << np.uint64(32)) | codes, return_counts=True)
                total = _add(total, (keys, n))
        for at in range(0, len(total[0]), 1 << 16):
            keys, n = total[0][at : at + (1 << 16)], total[1][at : at + (1 << 16)]
            yield pa.record_batch(
                {
                    "gram": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    "lang": pa.array((keys >> np.uint64(32)).astype(np.int32)),
                    "n": pa.array(n),
                }
            )

    parts = labelled.mapInArrow(run, "gram long, lang int, n long")
    return parts.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """Bit-sliced Bloom filter: ``slices[w][slot]`` has bit ``l % 64`` for language ``l`` of word ``w``."""

    def __init__(self, languages: list[str], slices: np.ndarray, default: int) -> None:
        self.languages, self.slices, self.default = languages, slices, default
        full = [np.mean((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
        self.chance = np.minimum(np.array(full) ** HASHES, 0.999)

    def containing(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """Masks of the languages that contain each gram."""
        a, *rest = slots_of(codes, self.slices.shape[1].bit_length() - 1)
        found = self.slices[word][a]
        for s in rest:
            found &= self.slices[word][s]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(self.languages)
        hits, seen = np.zeros((len(texts), n)), np.zeros(len(texts))
        for data, spans in _chunks(texts):
            codes, place = grams(data)
            rows = np.array([k for k, _, _ in spans])
            lo = np.searchsorted(place, [a for _, a, _ in spans])
            hi = np.searchsorted(place, [b for _, _, b in spans])
            np.add.at(seen, rows, hi - lo)
            for word in range(len(self.slices)):
                masks = self.containing(codes, word)
                for i in range(64 * word, min(n, 64 * word + 64)):
                    run = np.zeros(len(masks) + 1, np.int32)
                    np.cumsum((masks >> np.uint64(i % 64)) & np.uint64(1), out=run[1:], dtype=np.int32)
                    np.add.at(hits[:, i], rows, run[hi] - run[lo])
        real = np.maximum(0, (hits - seen[:, None] * self.chance) / (1 - self.chance))
        best = real.argmax(axis=1) if n else np.zeros(len(texts), int)
        names, scores = [], []
        for k, text in enumerate(texts):
            if not n or text is None or not _LETTER(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = real[k].sum()
            names.append(self.languages[best[k] if total else self.default])
            scores.append(float(real[k, best[k]] / total) if total else 0.0)
        return names, scores


def train(labelled: DataFrame, bits: int = FILTER_BITS) -> LanguageFilter:
    """Learn from all rows of (lang, text) whose language isn't null."""
    known = labelled.select(labelled["lang"].cast("string").alias("lang"), labelled["text"].cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; is this the language column?")
    words = max(1, -(-len(languages) // 64))
    slices = np.zeros((words, 1 << bits), np.uint64)
    if not languages:
        return LanguageFilter([], slices, 0)
    counts = written(count_grams(known, languages), "langid-counts")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if totals:
        sums = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (int(k), float(v))])
        rates = counts.withColumn("rate", F.col("n") / sums[F.col("lang")])
        tops = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("all"))
        chosen = tops.select("gram", "top", F.explode("all").alias("x")).select("gram", "x.lang", "x.rate", "top")
        chosen = chosen.filter((F.col("rate") >= MIN_RATE) & (F.col("rate") * SHARE >= F.col("top")))

        def place(parts):
            for part in parts:
                lang = part.column(1).to_numpy()
                bit = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
                for s in slots_of(part.column(0).to_numpy().astype(np.uint32), bits):
                    yield pa.record_batch({"word": pa.array((lang // 64).astype(np.int32)), "slot": pa.array(s), "mask": pa.array(bit)})

        filled = chosen.select("gram", "lang").mapInArrow(place, "word int, slot long, mask long")
        filled = filled.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        if filled.num_rows:
            w, s = filled.column("word").to_numpy(), filled.column("slot").to_numpy()
            slices[w, s] = filled.column("mask").to_numpy().view(np.uint64)
    return LanguageFilter(languages, slices, max(totals, key=lambda k: (totals[k], -k), default=0))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    seen = docs.filter(~held_out(id_col)).select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(seen))
    base = docs.select(
        docs[id_col].alias("doc_id"), held_out(id_col).alias("held_out"), docs[text_col].cast("string").alias("text")
    )

    def run(parts):
        own = model.value
        for part in (p for whole in parts for p in pieces(whole, 4 * CHUNK)):
            names, scores = own.predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
