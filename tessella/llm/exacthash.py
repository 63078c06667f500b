"""Exact deduplication over an extendible-hash index on shared files. DataFrame functions only.

Every text is normalised (white space ``[\\x20\\x09-\\x0D]`` deleted) and hashed to 64 bits. The
index keeps its entries in buckets of the hash space: a directory over the leading bits says
which bucket owns a range of hashes, an overfull bucket is split in two, and the directory
doubles whenever a bucket outgrows its depth. It stops at ``MAX_DEPTH`` bits, so that it can be
broadcast; the entries of a bucket that is still overfull lie on several pages, in hash order.

The directory routes every text to its bucket. There, the texts of a hash meet in the task that
owns the hash, which compares their bytes: the least and the greatest text are kept side by side.
If they are equal the chain of the hash has one link, which knows the number of rows and the row
that stays. If they differ, different texts collide, and those texts come again, one link of the
chain each, in the order of their bytes. Each task combines its rows of a hash before they move,
so a text that holds a third of all rows sends one row per task like any other.

Documents find their class through the index: the directory gives the bucket, bucket and hash
give the chain, and the SHA-256 of the normalised text picks the link. Should two links of a chain
ever have the same SHA-256, an error is raised.

Defined cases: a null text counts as empty; equal texts keep the row with most code points,
then the smallest id (of any type that can be ordered); a null id ranks after all others; rows
that repeat the kept row's id and length all count as kept (``drop_copies`` leaves one of them);
texts may be as long as a row can be; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lookup, written

#: Entries that a bucket holds before it is split.
BUCKET_ROWS = 512
#: Longest prefix of the hash that the directory tells apart; beyond it, buckets get more pages.
MAX_DEPTH = 16
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


class Directory:
    """Directory of an extendible hash: slots over the leading bits, buckets of local depth."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = [0]
        self.local = [0]

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in range(2)]
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Split a bucket; the new one takes the upper half of its range."""
        if self.local[bucket] == self.depth:
            self.double()
        own = [i for i, b in enumerate(self.slots) if b == bucket]
        new = len(self.local)
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        for i in own[len(own) // 2 :]:
            self.slots[i] = new
        return new

    @classmethod
    def fitted(cls, histogram: dict[int, int], bits: int, capacity: int) -> Directory:
        """Split from one bucket until none holds over ``capacity`` or is ``bits`` deep.

        ``histogram`` counts entries by their ``bits`` leading bits.
        """
        sums = [0]
        for cell in range(1 << bits):
            sums.append(sums[-1] + histogram.get(cell, 0))
        found = cls()
        todo = [(0, 0, 1 << bits)]  # bucket, first cell, end
        while todo:
            bucket, lo, hi = todo.pop()
            if sums[hi] - sums[lo] > capacity and hi - lo > 1:
                mid = (lo + hi) // 2
                todo += [(found.split(bucket), mid, hi), (bucket, lo, mid)]
        return found


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


class Index:
    """Directory and chains of a table of documents; ``entries`` has a row per document."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bucket_rows: int) -> None:
        norm = normalised(F.col(text_col))
        self.base = docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"),
            norm.alias("norm"),
            F.xxhash64(norm).alias("h"),
        )
        entries = self.base.select("doc_id", "n_cp", "h", F.sha2("norm", 256).alias("sha"))
        entries = written(entries, "ehash-entries")
        self._build_directory(entries.select("h").distinct(), bucket_rows)
        self.entries = self.routed(entries)
        self.chains = written(self._paged(self._chains(), bucket_rows), "ehash-index")

    def _build_directory(self, keys: DataFrame, bucket_rows: int) -> None:
        """Only counts per prefix reach the driver, at most 2**MAX_DEPTH of them."""
        bits = min(MAX_DEPTH, max(1, (keys.count() // bucket_rows).bit_length() + 2))
        cells = keys.groupBy(_slot(bits).alias("cell")).count().collect()
        self.directory = Directory.fitted({r["cell"]: r["count"] for r in cells}, bits, bucket_rows)
        listed = F.split(F.lit(",".join(map(str, self.directory.slots))), ",")
        slots = keys.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "bucket"))
        self.slots = written(slots.select(F.col("slot").cast("long"), F.col("bucket").cast("int")), "ehash-directory")

    def routed(self, rows: DataFrame) -> DataFrame:
        """Rows with a hash ``h``, and the bucket that the directory gives them."""
        return rows.withColumn("slot", _slot(self.directory.depth)).join(F.broadcast(self.slots), "slot").drop("slot")

    def _chains(self) -> DataFrame:
        """A row per distinct text: bucket, h, link, sha, n, keep_id, keep_cp."""
        first = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
        texts = self.routed(self.base)
        met = texts.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("n"), first, F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        met = met.select("bucket", "h", F.lit(1).alias("link"), F.sha2("lo", 256).alias("sha"), "n", "first", (F.col("lo") != F.col("hi")).alias("mixed"))
        met = written(met, "ehash-met")
        chains, mixed = met.filter("not mixed").drop("mixed"), met.filter("mixed").select("bucket", "h")
        if not mixed.isEmpty():
            apart = texts.join(mixed, ["bucket", "h"], "left_semi").groupBy("bucket", "h", "norm").agg(F.count(F.lit(1)).alias("n"), first)
            link = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("norm"))
            apart = apart.select("bucket", "h", link.alias("link"), F.sha2("norm", 256).alias("sha"), "n", "first")
            twin = F.lag("sha").over(Window.partitionBy("bucket", "h").orderBy("sha")) == F.col("sha")
            error = F.raise_error(F.lit("two different texts share hash and SHA-256")).cast("string")
            chains = chains.unionByName(apart.withColumn("sha", F.when(twin, error).otherwise(F.col("sha"))))
        return chains.select(
            "bucket", "h", "link", "sha", "n", F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("keep_cp")
        )

    def _paged(self, chains: DataFrame, bucket_rows: int) -> DataFrame:
        """Buckets laid out in hash order, ``bucket_rows`` entries to a page."""
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "link"))
        return chains.withColumn("page", F.floor((place - 1) / F.lit(bucket_rows)).cast("int"))


_KEYS = ["bucket", "h", "sha"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, page, link."""
    index = Index(docs, id_col, text_col, bucket_rows)
    both = lookup(index.entries, index.chains, _KEYS, "n", F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    return both.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "page", "link"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns."""
    index = Index(docs, id_col, text_col, bucket_rows)

    def named(c: str) -> Column:
        """An id as text, nulls apart from all others."""
        return F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("")).alias("id")

    norm = normalised(F.col(text_col))
    own = docs.select(
        F.struct("*").alias("row"),
        F.xxhash64(norm).alias("h"),
        F.sha2(norm, 256).alias("sha"),
        named(id_col),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("cp"),
    )
    keys = [*_KEYS, "id", "cp"]
    keep = index.chains.select(*_KEYS, named("keep_id"), F.col("keep_cp").alias("cp"))
    # rows that repeat the kept one's id and length are combined before they move, one of them stays
    stay = index.routed(own).dropDuplicates(keys).join(keep, keys, "left_semi")
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])
