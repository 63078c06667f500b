"""Ordered-sequence operators: windows and sorts over unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .storage import stored

Cols = list[str]


def _over(by: Cols, order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def consecutive(df: DataFrame, by: Cols, order: Cols, columns: Cols, prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of its successor; rows without one are left out."""
    w = _over(by, order)
    out = df.withColumn("_has", F.lead(F.lit(True)).over(w))
    for c in columns:
        out = out.withColumn(prefix + c, F.lead(c).over(w))
    return out.filter("_has").drop("_has")


def allowed_pairs(df: DataFrame, by: Cols, order: Cols, key: str, allowed: DataFrame) -> DataFrame:
    """Consecutive pairs of which both ends are in the allow-list (applied after pairing)."""
    pairs = consecutive(df, by, order, [key])
    left = pairs.join(allowed.select(F.col(key)), key, "left_semi")
    return left.join(allowed.select(F.col(key).alias(f"next_{key}")), f"next_{key}", "left_semi")


def label_pairs(labels: DataFrame, commits: DataFrame, project: str = "project", sha: str = "sha", order: Cols | None = None) -> DataFrame:
    """Pairs of labelled items whose commits are consecutive: two equi-joins on the pair table."""
    pairs = consecutive(commits, [project], order or ["authored", sha], [sha])
    pairs = pairs.select(project, sha, f"next_{sha}")
    left = labels.select(*[F.col(c).alias(f"a_{c}") for c in labels.columns])
    right = labels.select(*[F.col(c).alias(f"b_{c}") for c in labels.columns])
    out = pairs.join(left, (pairs[project] == left[f"a_{project}"]) & (pairs[sha] == left[f"a_{sha}"]))
    return out.join(right, (pairs[project] == right[f"b_{project}"]) & (pairs[f"next_{sha}"] == right[f"b_{sha}"]))


def changes_only(df: DataFrame, by: Cols, order: Cols, value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first of each run (gaps and islands)."""
    before = F.lag(value).over(_over(by, order))
    first = F.row_number().over(_over(by, order)) == 1
    return df.withColumn("_new", first | ~before.eqNullSafe(F.col(value))).filter("_new").drop("_new")


def islands(df: DataFrame, by: Cols, order: Cols, value: str, name: str = "island") -> DataFrame:
    """Number of the run of equal values that a row is in, from 0."""
    w = _over(by, order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w) - 1).drop("_new")


def running_before(df: DataFrame, by: Cols, order: Cols, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows: running depth, or offsets from sizes."""
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def carried(df: DataFrame, by: Cols, order: Cols, value: str, name: str) -> DataFrame:
    """Last value that isn't null, up to the row."""
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def ranked(df: DataFrame, by: Cols, order: Cols, name: str = "rank") -> DataFrame:
    """Place from 0."""
    return df.withColumn(name, F.row_number().over(_over(by, order)) - 1)


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Place in the order of the whole table, without sorting it in one task.

    Rows are dealt into ranges of the order and stored, so that both passes see the same ranges;
    places within a range are moved by the number of rows in the ranges before, of which there
    are as many as partitions.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    both = dealt.withColumn("_n", within).join(F.broadcast(sizes), "_range")
    return both.withColumn(name, (F.col("_before") + F.col("_n") + (start - 1)).cast("long")).drop("_range", "_before", "_n")


def first_of(df: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("_n", F.row_number().over(_over(key, order))).filter("_n = 1").drop("_n")


def first_n(df: DataFrame, by: Cols, order: Cols, n: int, at_least_one: bool = False) -> DataFrame:
    """The first ``n`` rows of each group; ``at_least_one`` lets a limit of 0 pass one row."""
    n = max(n, 1) if at_least_one else n
    return df.withColumn("_n", F.row_number().over(_over(by, order))).filter(F.col("_n") <= n).drop("_n")


def chunks(df: DataFrame, n: int, by: Cols, order: Cols, name: str = "chunk") -> DataFrame:
    """Nearly equal chunks, the first ones larger by one, from 0."""
    return df.withColumn(name, F.ntile(n).over(_over(by, order)) - 1)


def traversal(df: DataFrame, by: Cols, order: Cols, start: Column, strategy: str) -> DataFrame:
    """Order of a walk from the row where ``start`` holds, as column ``step`` from 0.

    ``new_first``: the start, then older rows. ``old_first``: the start, then newer rows.
    ``curlicue_new`` and ``curlicue_old``: away from the start on both sides in turns, the newer
    or the older side first; when one side ends the other goes on.
    """
    w = _over(by, order)
    out = df.withColumn("_n", F.row_number().over(w))
    whole = Window.partitionBy(*by)
    out = out.withColumn("_c", F.max(F.when(start, F.col("_n"))).over(whole))
    d = F.col("_n") - F.col("_c")
    if strategy == "new_first":
        out, key = out.filter(d <= 0), -d
    elif strategy == "old_first":
        out, key = out.filter(d >= 0), d
    elif strategy in ("curlicue_new", "curlicue_old"):
        ahead = d > 0 if strategy == "curlicue_new" else d < 0
        key = F.when(d == 0, 0).otherwise(F.abs(d) * 2 - F.when(ahead, 1).otherwise(0))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = out.withColumn("_key", key)
    return out.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy("_key")) - 1).drop("_n", "_c", "_key")


def skip_unchanged(df: DataFrame, by: Cols, order: Cols, digest: str) -> DataFrame:
    """Commits whose sources differ from those of the last one that was yielded."""
    return changes_only(df, by, order, digest)


def merged(parts: list[DataFrame], order: Cols) -> DataFrame:
    """Ordered union of ordered inputs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def least_recently_used(df: DataFrame, key: str, used: str) -> DataFrame:
    """The row to evict."""
    return df.agg(F.min_by(key, F.struct(used, key)).alias(key))
