"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import max_version, version_key

#: Labels of extraction statuses.
STATUS = {1: "success", 2: "build error", 3: "cache error", 4: "other error"}


def status_counts(df: DataFrame, status: str, classes: DataFrame) -> DataFrame:
    """Number of rows of each class, classes without any included."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(classes).join(counts, status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def status_message(counts: DataFrame, status: str) -> DataFrame:
    """One line per class."""
    return counts.select(F.concat_ws(": ", F.col(status).cast("string"), F.col("n").cast("string")).alias("message"))


def latest(df: DataFrame, by: list[str], value: str, ts: str, priority: Column) -> DataFrame:
    """Value at the latest time; of equal times the least priority counts."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.col(ts), (-priority).alias("p"))).alias(value))


def latest_status(events: DataFrame, by: list[str], kind: str, ts: str, success: str) -> DataFrame:
    """Latest error kind (cache, build, misc rank in this order), unless there is a success."""
    order = F.when(F.col(kind) == "cache", 0).when(F.col(kind) == "build", 1).otherwise(2)
    return events.groupBy(*by).agg(
        F.when(F.bool_or(F.col(kind) == success), F.lit(success))
        .otherwise(F.max_by(kind, F.struct(F.col(ts), (-order).alias("p"))))
        .alias("status")
    )


def max_versions(df: DataFrame, by: list[str], version: str, mode: str = "lexical") -> DataFrame:
    return df.groupBy(*by).agg(max_version(F.col(version), mode).alias(version))


def newest_success(df: DataFrame, by: list[str], version: str, ok: Column) -> DataFrame:
    """Newest version that succeeded."""
    return df.filter(ok).groupBy(*by).agg(F.max_by(version, version_key(F.col(version))).alias(version))


def distinct_counts(df: DataFrame, **keys: list[str]) -> DataFrame:
    """Numbers of distinct keys, one column each, and of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(*cols).alias(name) for name, cols in keys.items()])


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        df.groupBy(*by)
        .agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            q.alias("q"),
            F.max(value).alias("max"),
        )
        .select(*by, "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")
    )


def describe_counts(df: DataFrame, by: list[str], unit: list[str], distinct: list[str] | None = None) -> DataFrame:
    """Rows (or distinct keys) per unit, described per group."""
    n = F.countDistinct(*distinct) if distinct else F.count(F.lit(1))
    return describe(df.groupBy(*by, *unit).agg(n.alias("n")), by, "n")


def frequency(df: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Number of rows per value, the most frequent first."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)
    return out.limit(top) if top else out


def histogram(df: DataFrame, value: str, width: float | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Share of rows per value, or per bin ``[k * width, (k + 1) * width)`` of those within ``[lo, hi)``."""
    x = F.col(value)
    if lo is not None:
        df = df.filter(x >= lo)
    if hi is not None:
        df = df.filter(x < hi)
    bin_ = F.floor(x / F.lit(width)).cast("long") if width else x
    counts = df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return share(counts, "n", "proportion", 1.0)


def share(df: DataFrame, value: str, name: str = "percent", of: float = 100.0) -> DataFrame:
    """Part of the total; the window runs over the few rows of an aggregate."""
    return df.withColumn(name, F.col(value) * F.lit(of) / F.sum(value).over(Window.partitionBy()))


def sum_of_max(df: DataFrame, outer: list[str], inner: list[str], key: list[str]) -> DataFrame:
    """Sum over groups of the largest number of distinct keys of any of its units."""
    n = df.groupBy(*outer, *inner).agg(F.countDistinct(*key).alias("n"))
    return n.groupBy(*outer).agg(F.max("n").alias("n")).agg(F.sum("n").alias("total"))


def totals(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Sums per group, subtotals and the grand total."""
    return df.rollup(*by).agg(*[c.alias(n) for n, c in sums.items()])


def per_version(df: DataFrame, version: str, **sums: Column) -> DataFrame:
    """Sums per version, the newest first."""
    out = df.groupBy(version).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in sums.items()])
    return out.orderBy(version_key(F.col(version)).desc())


def fold_ordered(df: DataFrame, by: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """``fn(key, rows)`` over each group's rows in order, as an Arrow-backed pandas frame."""

    def run(key, rows):
        return fn(key, rows.sort_values(order, kind="stable"))

    return df.groupBy(*by).applyInPandas(run, schema)
