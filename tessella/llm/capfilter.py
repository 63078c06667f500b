"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector is turned by a random rotation and cut into two blocks. Each block has a code of
``M`` random unit directions; a filter is a pair of them, so ``M`` * ``M`` filters cost 2 * ``M``
inner products. List decoding finds all filters whose direction exceeds the cap's height: block
scores are summed pairwise, after dropping directions that no partner can lift over the height.
The height is set (from random unit vectors, not from the data) so that a vector falls into
``CAPS`` filters on average; a vector with few takes its best ones, ``LEAST`` times as many.
``TURNS`` rotations are used side by side. Of simulated pairs at cosine 0.931 in 64 dimensions, one
in a thousand or fewer shared no filter with codes of 256 to 16,384 directions; the code grows with
the square root of the rows of a label, and the filters a vector has grow with the code.

Vectors are joined on (length, label, filter) and verified by cosine in double precision. Buckets are
cut into blocks of at most ``BLOCK`` vectors, and each pair of blocks is one piece of work, so
no bucket has to fit into a task. A pair that shares several filters counts in the first of
them. No pair is emitted: a piece returns the number of links per vector and a spanning forest
of what it links. Equal vectors of a label are one class that enters once with its size.

Vectors of each length have filters of their own and link with each other only.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, and so do those without a label; a null id
ranks below others; rows may repeat, and equal vectors link like any others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lookup, written

COSINE = 0.93
#: Per rotation: filters of a vector on average (for codes of up to WIDE directions; finer ones take
#: more, in proportion to the fourth root, which keeps the recall), and the share it has at least.
CAPS, LEAST, WIDE = 8, 0.75, 1024
TURNS = 4
#: Vectors that fall into a filter by chance, which sets M. The largest code (some 150 MB a worker)
#: serves six billion vectors a label; beyond that buckets grow and are still compared in full.
CHANCE = 32
MIN_CODE, MAX_CODE = 64, 1 << 16
BLOCK = 2048
SEED = 20240229


class ProductCode:
    """Random product code over unit vectors of a dimension."""

    def __init__(self, dimension: int, size: int, caps: float = CAPS, seed: int = SEED) -> None:
        self.dimension, self.size = dimension, size
        self.least = min(int(caps * LEAST), size * size)
        random = np.random.default_rng(seed)
        width = max(2, dimension + dimension % 2)
        turn, upper = np.linalg.qr(random.standard_normal((width, width)))
        self.turn = (turn * np.sign(np.diag(upper)))[:dimension]
        codes = random.standard_normal((2, size, width // 2))
        self.codes = codes / np.linalg.norm(codes, axis=2, keepdims=True) / math.sqrt(2)
        sample = random.standard_normal((256, dimension))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        a, b = self.scores(sample)
        top = min(size, 512)  # the greatest sums are those of great scores
        a, b = (np.partition(x, size - top, axis=1)[:, size - top :] for x in (a, b))
        most = min(4096, top * top)
        rows = np.concatenate([np.partition((x[:, None] + y[None, :]).ravel(), top * top - most)[-most:] for x, y in zip(a, b, strict=True)])
        want = int(min(caps, size * size) * len(sample))
        self.height = float(np.partition(rows, -want)[-want])

    def scores(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = vectors @ self.turn
        half = turned.shape[1] // 2
        return turned[:, :half] @ self.codes[0].T, turned[:, half:] @ self.codes[1].T

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """All filters that each unit vector exceeds, in rising order; its best ones if they are too few."""
        step = max(1, (1 << 21) // self.size)
        return [caps for at in range(0, len(vectors), step) for caps in self._decode(vectors[at : at + step])]

    def _decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        a, b = self.scores(vectors)
        out = []
        for x, y in zip(a, b, strict=True):
            height = self.height
            while True:
                i = np.flatnonzero(x + y.max() >= height)
                j = np.flatnonzero(y + x.max() >= height)
                sums = x[i, None] + y[None, j]
                hit = np.argwhere(sums >= height)
                if len(hit) >= self.least:
                    break
                height -= 0.03
            if height < self.height and len(hit) > self.least:
                best = np.argpartition(-sums[hit[:, 0], hit[:, 1]], self.least)[: self.least]
                hit = hit[best]
            out.append(np.sort(i[hit[:, 0]] * self.size + j[hit[:, 1]]))
        return out


class CapFilters:
    """Several product codes side by side."""

    def __init__(self, dimension: int, size: int) -> None:
        self.size = size
        caps = CAPS * max(1.0, size / WIDE) ** 0.25
        self.codes = [ProductCode(dimension, size, caps, SEED + t) for t in range(TURNS)]

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        found = [code.decode(vectors) for code in self.codes]
        return [np.concatenate([c + t * self.size**2 for t, c in enumerate(own)]) for own in zip(*found, strict=True)]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect as much as all (a, b) do."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _shares_earlier(caps_a: list[np.ndarray], caps_b: list[np.ndarray], cap: int) -> np.ndarray:
    """Which pairs share a filter below ``cap``."""
    before_a = [c[: np.searchsorted(c, cap)] for c in caps_a]
    before_b = [c[: np.searchsorted(c, cap)] for c in caps_b]
    names = np.unique(np.concatenate([*before_a, *before_b])) if caps_a or caps_b else np.zeros(0, np.int64)
    if not len(names):
        return np.zeros((len(caps_a), len(caps_b)), bool)

    def member(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(some), len(names)), np.float32)
        for k, c in enumerate(some):
            out[k, np.searchsorted(names, c)] = 1
        return out

    return member(before_a) @ member(before_b).T > 0


def _piece(kind: type, cosine: float):
    """Links of one pair of blocks of a bucket: counts per class and a spanning forest."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cap, first, second = key[1].as_py(), key[2].as_py(), key[3].as_py()
        block = table.column("block").to_numpy()
        order = np.lexsort((table.column("rep").to_numpy(), block))
        table, block = table.take(pa.array(order)), block[order]
        uid, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        vectors = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(uid), -1))
        caps = [c.values.to_numpy() for c in table.column("caps")]
        left = np.flatnonzero(block == first)
        right = np.flatnonzero(block == second) if second != first else left
        count, links_a, links_b = np.zeros(len(uid), np.int64), [], []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            near = vectors[some] @ vectors[right].T >= cosine
            if first == second:
                near &= some[:, None] < right[None, :]
            if near.any():
                near &= ~_shares_earlier([caps[i] for i in some], [caps[i] for i in right], cap)
                i, j = np.nonzero(near)
                i, j = some[i], right[j]
                np.add.at(count, i, size[j])
                np.add.at(count, j, size[i])
                for a, b in _forest(i, j, len(uid)):
                    links_a.append(a)
                    links_b.append(b)
        forest = _forest(np.array(links_a, int), np.array(links_b, int), len(uid))
        some = np.flatnonzero(count)
        a = np.concatenate([uid[some], uid[[x for x, _ in forest]] if forest else uid[:0]])
        b = np.concatenate([np.full(len(some), -1, np.int64), uid[[y for _, y in forest]] if forest else uid[:0]])
        n = np.concatenate([count[some], np.zeros(len(forest), np.int64)])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    block: int = BLOCK,
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64
    wide = "array<float>" if kind is np.float32 else "array<double>"
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(wide).alias("vector"), F.col(label_col).cast("string").alias("label")
    )
    # rows: numbered by what identifies a class, the label and the vector's bytes
    fine = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    fine = fine & F.exists("vector", lambda x: x != 0)
    rows = base.select(
        "vec_id", "label", F.coalesce(fine, F.lit(False)).alias("fine"), F.when(fine, F.col("vector")).alias("vector")
    )
    # -0.0 and 0.0 are equal; a class is known by 128 bits of its label and vector
    same = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast("float" if kind is np.float32 else "double")).otherwise(x))
    text = F.to_json(F.struct("label", same.alias("v")))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.md5(text)))
    entries = written(rows.select("vec_id", "key"), "cap-rows")
    classes = rows.filter("fine").groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = classes.withColumn("d", F.size("vector"))
    # numbered by partition and place, once, as the table is written: no two classes share a number
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "cap-classes")
    tops = classes.groupBy("d", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    codes = {}
    for d, top in tops:
        want = math.sqrt(max(1.0, top * CAPS / CHANCE))
        codes[d] = CapFilters(d, int(min(MAX_CODE, max(MIN_CODE, 2 ** math.ceil(math.log2(want))))))
    shared = spark.sparkContext.broadcast(codes)

    def decode(parts):
        own = shared.value
        for mixed in parts:
            lengths = mixed.column(3).to_numpy()
            for d in np.unique(lengths).tolist():
                part = mixed.take(pa.array(np.flatnonzero(lengths == d)))
                lists = part.column(4)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), d)
                found = own[d].decode(_unit(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.array([r.tobytes() for r in flat], pa.binary()),
                        pa.array([c.astype(np.int64) for c in found], pa.list_(pa.int64())),
                    ],
                    names=["rep", "size", "label", "d", "vector", "caps"],
                )

    filed = classes.select("rep", "size", "label", "d", "vector").mapInArrow(
        decode, "rep long, size long, label string, d int, vector binary, caps array<long>"
    )
    filed = written(filed, "cap-filters")
    spread = filed.select("rep", "label", "d", F.explode("caps").alias("cap"))
    buckets = spread.groupBy("label", "cap", "d").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1")
    spread = lookup(spread, buckets, ["label", "cap", "d"], "in_bucket", F.col("rep"))
    spread = spread.filter("in_bucket > 1").withColumn("blocks", F.ceil(F.col("in_bucket") / F.lit(block)).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "label", "cap", "d", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep"
    )
    pieces = spread.join(filed.select("rep", "size", "vector", "caps"), "rep")
    work = pieces.groupBy("label", "cap", "first", "second", "d").applyInArrow(
        _piece(kind, cosine), "a long, b long, n long"
    )
    work = written(work, "cap-links")
    counts = work.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = components(work.filter("b >= 0").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.select("key", "rep", "size", "least").join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    tops = known.groupBy("component").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("members"))
    known = lookup(known, tops, ["component"], "members", F.col("rep"))
    known = known.select("key", "size", "top", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    both = lookup(entries, known, ["key"], "size", F.col("vec_id"))
    component = F.coalesce("top", "vec_id")
    return both.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
