"""Near-duplicate detection with DartMinHash signatures of weighted word shingles.

A text is the weighted set of its five-word shingles (fewer words: one shingle), the weight
being how often a shingle occurs. Element regions are cut into cells of unit weight, one per
occurrence. Hashes throw darts into a cell at random ranks, as a Poisson process that depends on
the cell alone; a text sees the darts in its cells up to the rank at which enough darts for all
``COORDINATES`` are expected. Each dart aims at one coordinate, and the earliest dart per
coordinate is the signature, so two texts agree in a coordinate with the probability of their
weighted Jaccard similarity. The cost is one draw per cell plus the darts themselves.

Signatures are joined by bands of ``ROWS`` coordinates: at similarity 0.8 a pair shares one of
``BANDS`` bands with probability 0.9998. Only links that the exact weighted Jaccard similarity
confirms count. Texts with equal words form one class and enter once. Within a band's bucket
no pairs are formed: members are compared with leaders, connected components are taken, and
only buckets that still hold several components go on. After ``STAR_ROUNDS`` rounds every
member outside its bucket's largest component is compared with all members of other components,
so components are as if all pairs of the bucket had been compared: members are packed into
blocks, and each pair of blocks is one piece of work that multiplies 0/1 matrices of cells and
returns a spanning forest of what it links. No pair is left out, whatever the bucket's size.

Texts are stored once as numbered batches; the sets of leaders travel to the members' batches.

Defined cases: a null text, or one without words, links with nothing; a null id ranks after all
others; of rows repeated in every column exactly one is kept; an empty table gives an empty
result; ``drop_near_copies`` passes other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ROW_BITS, lookup, new_folder, read_batch, spill_batches, tidy, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
STAR_ROUNDS = 3
#: Members, and cells of members, of a block.
BLOCK, BLOCK_CELLS = 2048, 1 << 21
BATCH_BYTES = 4 << 20
#: Batches that fall to a task that writes what is left of them.
TASK_BATCHES = 4
CHUNK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        row = np.full(max(n, CHUNK + (1 << 16)), base, dtype=np.uint64)
        row[0] = 1
        _tables[base] = np.cumprod(row, dtype=np.uint64)
    return _tables[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all texts (sorted per text) and the bounds of each text's cells."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power(_BASE, len(data)), out=sums[1:], dtype=np.uint64)
    word = _mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(count)
    n = np.maximum(count - WORDS + 1, np.minimum(count, 1))  # shingles per text
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + (last - count)[owner]
    shingle = np.zeros(len(place), np.uint64)
    for k in range(WORDS):
        at = place + k
        ok = at < last[owner]
        shingle[ok] = _mix(shingle[ok] * _U(_BASE) + word[at[ok]])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]) if len(order) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    nth = (np.arange(len(new)) - begun).astype(np.uint64)
    return _mix(shingle + nth * _U(0xD6E8FEB86659FD93)), np.concatenate([[0], np.cumsum(n)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(cell: np.ndarray, bounds: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """A row of ``k`` darts per text; all zero for texts without cells."""
    n = len(bounds) - 1
    out = np.zeros((n, k), np.uint64)
    weight = np.diff(bounds)
    todo = np.flatnonzero(weight)
    reach = (k * math.log(k) + 4 * k) / np.maximum(weight, 1)
    while len(todo):
        size = weight[todo]
        doc = np.repeat(todo, size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + bounds[doc]
        own, limit = cell[at], reach[doc]
        rank = np.zeros(len(own))
        found = []
        nth = 0
        while len(own):
            nth += 1
            draw = _mix(own + _U((nth * 0xA0761D6478BD642F) & ((1 << 64) - 1)))
            u = _uniform(draw)
            if nth == 1:  # most cells of a long text have no dart: settle that without logarithms
                hit = u >= np.exp(-limit)
                own, doc, limit, rank, draw, u = own[hit], doc[hit], limit[hit], rank[hit], draw[hit], u[hit]
            rank = rank - np.log(u)
            hit = rank <= limit
            own, doc, limit, rank, draw = own[hit], doc[hit], limit[hit], rank[hit], draw[hit]
            found.append((doc, rank, _mix(draw ^ _U(0x8EBC6AF09C88C6E3))))
        doc, rank, dart = (np.concatenate(c) for c in zip(*found, strict=True))
        aim = ((dart >> _U(32)) * _U(k)) >> _U(32)
        slot = doc.astype(np.uint64) * _U(k) + aim
        order = np.argsort((slot << _U(32)) | rank.astype(np.float32).view(np.uint32).astype(np.uint64), kind="stable")
        slot = slot[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        slot, dart = slot[first].astype(np.int64), dart[order][first] | _U(1)
        out[slot // k, slot % k] = dart
        todo = todo[(out[todo] == 0).any(axis=1)]
        out[todo] = 0
        reach[todo] *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """``BANDS`` numbers per text."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        found = _mix(found * _U(_BASE) + parts[:, :, r])
    return found.view(np.int64)


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def _groups(texts: list[bytes]):
    """Slices of about CHUNK bytes."""
    at = used = 0
    for i, t in enumerate(texts):
        if used and used + len(t) > CHUNK:
            yield at, i
            at, used = i, 0
        used += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of cells."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(folder: str, id_col: str, text_col: str):
    """Per row of a batch: uid, id, digest of its words, number of cells, bands."""

    def use(rows: pa.Table, number: int):
        ids = pa.concat_arrays(rows.column(id_col).cast(pa.int64()).chunks)
        texts = _lower(rows.column(text_col).to_pylist())
        for lo, hi in _groups(texts):
            part = texts[lo:hi]
            cell, bounds = cells(part)
            weight = np.diff(bounds)
            signature = signatures(cell, bounds)
            uid = (np.int64(number) << ROW_BITS) + np.arange(lo, hi)
            digest = np.array(
                [np.frombuffer(hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest(), np.int64) for t in part]
            ).reshape(-1, 2)
            digest[weight == 0] = np.stack([uid, np.full(len(uid), -1)], axis=1)[weight == 0]
            offsets = pa.array(np.arange(0, (len(part) + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.record_batch(
                {
                    "uid": pa.array(uid),
                    "id": ids.slice(lo, hi - lo),
                    "d1": pa.array(digest[:, 0].copy()),
                    "d2": pa.array(digest[:, 1].copy()),
                    "weight": pa.array(weight.astype(np.int64)),
                    "bands": pa.ListArray.from_arrays(offsets, pa.array(bands(signature).ravel())),
                }
            )

    return use


def _sets(folder: str, text_col: str):
    """Sets of cells of the rows of a batch that are asked for."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = read_batch(folder, key[0].as_py())
        uid = table.column("uid").to_numpy()
        texts = _lower(rows.column(text_col).take(pa.array(uid & ((1 << ROW_BITS) - 1))).to_pylist())
        found = []
        for lo, hi in _groups(texts):
            cell, bounds = cells(texts[lo:hi])
            found += [np.sort(cell[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        tidy()
        return pa.table({"uid": pa.array(uid), "cells": pa.array(found, pa.binary())})

    return run


def _verify(folder: str, text_col: str, least: float):
    """Links of the rows of a batch with the leaders whose sets come along."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = read_batch(folder, key[0].as_py())
        members = table.column("members").to_pylist()
        wanted = np.unique(np.concatenate([np.array(m, np.int64) for m in members]))
        texts = _lower(rows.column(text_col).take(pa.array(wanted & ((1 << ROW_BITS) - 1))).to_pylist())
        own: dict[int, np.ndarray] = {}
        for lo, hi in _groups(texts):
            cell, bounds = cells(texts[lo:hi])
            for i in range(hi - lo):
                own[int(wanted[lo + i])] = np.sort(cell[bounds[i] : bounds[i + 1]])
        a, b = [], []
        for leader, data, some in zip(table.column("leader").to_pylist(), table.column("cells"), members, strict=True):
            other = np.frombuffer(data.as_py(), np.uint64)
            for uid in some:
                if similarity(other, own[uid]) >= least - 1e-12:
                    a.append(leader)
                    b.append(uid)
        tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for all members of a block."""
    uid = table.column("uid").to_numpy()
    order = np.argsort(uid)
    data = table.column("cells").take(pa.array(order)).to_pylist()
    return pa.table(
        {
            "band": pa.array([key[0].as_py()], pa.int64()),
            "block": pa.array([key[1].as_py()], pa.int32()),
            "others": table.column("others").slice(0, 1),
            "mains": table.column("mains").slice(0, 1),
            "uids": [uid[order].tobytes()],
            "components": [table.column("component").to_numpy()[order].tobytes()],
            "sizes": [np.array([len(x) // 8 for x in data], np.int64).tobytes()],
            "cells": [b"".join(data)],
        }
    )


def _overlaps(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another, by products of 0/1 matrices."""
    names = np.intersect1d(a, b)
    out = np.zeros((len(a_sizes), len(b_sizes)))

    def places(cell: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(names, cell)
        hit = names[np.minimum(col, len(names) - 1)] == cell
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    if not len(names):
        return out
    (ra, ca), (rb, cb) = places(a, a_sizes), places(b, b_sizes)
    for at in range(0, len(names), 1024):
        x, y = np.zeros((len(a_sizes), 1024), np.float32), np.zeros((len(b_sizes), 1024), np.float32)
        i, j = np.searchsorted(ca, [at, at + 1024])
        x[ra[i:j], ca[i:j] - at] = 1
        i, j = np.searchsorted(cb, [at, at + 1024])
        y[rb[i:j], cb[i:j] - at] = 1
        out += x @ y.T
    return out


def _block_links(least: float):
    """Links between the members of two blocks that join different components, as a forest.

    Whole cells are compared, as ``similarity`` does, so every edge of the forest is a link.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = []
        for k in np.argsort(table.column("block").to_numpy(), kind="stable").tolist():
            raw = [table.column(c)[k].as_py() for c in ("uids", "components", "sizes", "cells")]
            blocks.append([np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.int64, np.uint64), strict=True)])
        (uid, comp, size, cell), (uid2, comp2, size2, cell2) = blocks[0], blocks[-1]
        both = _overlaps(cell, size, cell2, size2)
        # one row of the matrix at a time: nearly all pairs of a group of copies are near. An edge
        # merges two components at once, so each row meets every component once at most
        out = []
        for i in np.flatnonzero(size).tolist():
            near = both[i] >= (least - 1e-12) * (size[i] + size2 - both[i])
            at = np.flatnonzero(near & (comp2 != comp[i]))
            if len(at):
                met, first = np.unique(comp2[at], return_index=True)
                out += [(int(uid[i]), int(uid2[j])) for j in at[first].tolist()]
                here = comp[i]
                comp = np.where(np.isin(comp, met), here, comp)
                comp2 = np.where(np.isin(comp2, met), here, comp2)
        tidy()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _batch(uid: str) -> Column:
    return F.shiftright(uid, ROW_BITS)


class _Search:
    """Candidate search over the classes' bands."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, least: float, batch_bytes: int) -> None:
        spark = docs.sparkSession
        self.folder, self.text, self.least = new_folder(spark, "dart-batches"), text_col, least
        use = _signed(self.folder, id_col, text_col)
        signed = docs.mapInArrow(
            spill_batches(self.folder, batch_bytes, use),
            "uid long, id long, d1 long, d2 long, weight long, bands array<long>",
        )
        self.rows = written(signed, "dart-signatures")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid")))
        self.classes = written(
            self.rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select(
                "d1", "d2", "n", F.col("f.uid").alias("rep"), F.col("f.id").alias("class_id")
            ),
            "dart-classes",
        )

    def links(self) -> DataFrame:
        """Verified links (a, b) between classes' representatives: a spanning set of all links."""
        reps = self.rows.filter(F.col("weight") > 0).join(self.classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
        spread = reps.select("uid", "weight", F.posexplode("bands").alias("nth", "band"))
        sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # a text that shares many bands with many others is near the middle of its group: it leads
        members = lookup(spread, sizes, ["band"], "n", F.col("uid")).filter(F.col("n") > 1)
        members = members.groupBy("uid", "weight").agg(
            F.sum("n").alias("central"), F.collect_list(F.struct("nth", "band", "n")).alias("own")
        )
        members = written(
            members.select("uid", "weight", "central", F.explode("own").alias("o")).select("uid", "weight", "central", "o.*"),
            "dart-members",
        )
        found = None
        for step in range(STAR_ROUNDS):
            now = self._with_components(members, found)
            mixed = self._leaders(now, step)
            pairs = lookup(now.drop("n"), mixed, ["band"], "n", F.col("uid"))
            pairs = pairs.filter(F.col("leader").isNotNull() & (F.col("component") != F.col("main")))
            pairs = pairs.filter(self._sizes_fit("weight", "leader_weight"))
            pairs = written(pairs.select("leader", F.col("uid").alias("member")).distinct(), "dart-pairs")
            if not pairs.isEmpty():
                found = self._confirmed(pairs, found)
            elif mixed.isEmpty():
                break
        else:
            rest = self._rest(self._with_components(members, found))
            found = rest if found is None else rest.unionByName(found)
        return found if found is not None else members.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0)

    def _sizes_fit(self, a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * F.lit(self.least - 1e-9)

    def _with_components(self, members: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return members.withColumn("component", F.col("uid"))
        parts = components(links).select(F.col("node").alias("uid"), "component")
        return members.join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid"))

    def _leaders(self, now: DataFrame, step: int) -> DataFrame:
        """Of each bucket with several components: its most central member, by chance another one in later rounds."""
        draw = F.pmod(F.xxhash64("uid", F.lit(step), F.col("nth") % 2), F.lit(1 << 20)) / F.lit(float(1 << 20))
        order = F.col("central") * (draw + 0.5 if step else F.lit(1.0))
        lead = F.max(F.struct(order.alias("order"), "uid", "weight", "component"))
        found = now.groupBy("band").agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), lead.alias("lead")
        )
        return found.filter("lo <> hi").select(
            "band", "n", F.col("lead.uid").alias("leader"), F.col("lead.weight").alias("leader_weight"), F.col("lead.component").alias("main")
        )

    def _confirmed(self, pairs: DataFrame, found: DataFrame | None) -> DataFrame:
        """Links found so far, and those pairs that are similar enough."""
        leaders = pairs.select(F.col("leader").alias("uid")).distinct().withColumn("batch", _batch("uid"))
        sets = leaders.groupBy("batch").applyInArrow(_sets(self.folder, self.text), "uid long, cells binary")
        # a leader's set goes once to each batch that has members of it
        asked = pairs.withColumn("batch", _batch("member")).groupBy("batch", "leader").agg(F.collect_list("member").alias("members"))
        # Spark takes the sets for as small as the ids they are made from and would broadcast them
        sent = asked.join(sets.withColumnRenamed("uid", "leader").hint("merge"), "leader")
        new = sent.groupBy("batch").applyInArrow(_verify(self.folder, self.text, self.least), "a long, b long")
        return written(new if found is None else new.unionByName(found), "dart-links")

    def _rest(self, now: DataFrame) -> DataFrame:
        """Links among members of different components, one of them outside its bucket's largest component.

        Such members, and those of the largest component, are packed into blocks of bounded size;
        each pair of blocks is one piece of work that returns a spanning forest of its links.
        """
        parts = now.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("band").agg(
            F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")
        )
        main = main.filter("kinds > 1").select("band", "n", F.col("top.component").alias("main"))
        here = lookup(now.select("band", "uid", "weight", "component"), main, ["band"], "n", F.col("uid")).filter("n is not null")
        here = here.withColumn("outside", F.col("component") != F.col("main"))
        here = written(here.select("band", "uid", "weight", "component", "outside"), "dart-mixed")

        def blocks(some) -> Column:
            rows, cells_ = F.count(F.when(some, 1)), F.coalesce(F.sum(F.when(some, F.col("weight"))), F.lit(0))
            return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(cells_ / F.lit(BLOCK_CELLS))).cast("int")

        sizes = here.groupBy("band").agg(
            F.count(F.lit(1)).alias("n"), blocks(F.col("outside")).alias("others"), blocks(~F.col("outside")).alias("mains")
        )
        placed = lookup(here, sizes, ["band"], "n", F.col("uid"))
        draw = F.xxhash64("uid", F.lit("block"))
        block = F.when(F.col("outside"), F.pmod(draw, F.col("others"))).otherwise(F.col("others") + F.pmod(draw, F.col("mains")))
        placed = placed.withColumn("block", block.cast("int"))
        wanted = here.select("uid").distinct().withColumn("batch", _batch("uid"))
        sets = wanted.groupBy("batch").applyInArrow(_sets(self.folder, self.text), "uid long, cells binary")
        full = placed.join(sets.hint("merge"), "uid")
        packed = full.groupBy("band", "block").applyInArrow(
            _pack, "band long, block int, others int, mains int, uids binary, components binary, sizes binary, cells binary"
        )
        packed = written(packed, "dart-blocks")
        every = F.sequence(F.lit(0), F.when(F.col("block") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1)
        pairs = packed.withColumn("with", F.explode(every)).withColumns(
            {"first": F.least("block", "with"), "second": F.greatest("block", "with")}
        )
        pairs = pairs.select("band", "first", "second", "block", "uids", "components", "sizes", "cells")
        found = pairs.groupBy("band", "first", "second").applyInArrow(_block_links(self.least), "a long, b long")
        return written(found.distinct(), "dart-rest")

    def grouped(self) -> DataFrame:
        """Per row: uid, id, class_id, component_id, group_size, keeper."""
        parts = components(self.links()).select(F.col("node").alias("rep"), "component")
        known = self.classes.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        first = F.min(F.struct(F.col("class_id").isNull().alias("none"), F.col("class_id"), F.col("rep")))
        tops = known.groupBy("component").agg(
            first.alias("f"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("members")
        )
        classes = lookup(known, tops, ["component"], "members", F.col("rep"))
        classes = classes.select(
            "d1", "d2", "n", "class_id", F.col("f.class_id").alias("component_id"), F.col("f.rep").alias("keeper"), F.col("size").alias("group_size")
        )
        return lookup(self.rows.select("uid", "id", "d1", "d2"), classes, ["d1", "d2"], "n", F.col("uid"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """A row per document: doc_id, class_id (texts of equal words), component_id, group_size, kept."""
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    found = _Search(base, "id", "text", least, batch_bytes).grouped()
    kept = F.col("uid") == F.col("keeper")
    return found.select(F.col("id").alias("doc_id"), "class_id", "component_id", "group_size", kept.alias("kept"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, one per component, with all their columns."""
    columns = docs.columns
    base = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    search = _Search(base, f"c{columns.index(id_col)}", f"c{columns.index(text_col)}", least, batch_bytes)
    stay = search.grouped().filter(F.col("uid") == F.col("keeper")).select("uid", _batch("uid").alias("batch"))
    # ids are small, the batches that they ask for aren't: a stated number of tasks, which adaptive
    # execution doesn't merge into a few
    batches = search.rows.agg(F.count_distinct(_batch("uid"))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-batches // TASK_BATCHES))
    stay = stay.repartition(tasks, "batch")
    folder = search.folder

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = read_batch(folder, key[0].as_py())
        at = np.sort(table.column("uid").to_numpy() & ((1 << ROW_BITS) - 1))
        return rows.take(pa.array(at))

    return stay.groupBy("batch").applyInArrow(run, base.schema).toDF(*columns)
