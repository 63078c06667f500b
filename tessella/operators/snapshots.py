"""Snapshot diffs, patches and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], text: str, others: list[str]) -> DataFrame:
    """Full outer join of two snapshots, classified.

    added, dropped, changed (the text differs), affected (anything else differs) or unchanged.
    """
    cols = [text, *others]
    b = before.select(*key, *[F.col(c).alias(f"before_{c}") for c in cols], F.lit(True).alias("_b"))
    a = after.select(*key, *[F.col(c).alias(f"after_{c}") for c in cols], F.lit(True).alias("_a"))
    same = F.lit(True)
    for c in others:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    kind = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "dropped")
        .when(~F.col(f"before_{text}").eqNullSafe(F.col(f"after_{text}")), "changed")
        .when(~same, "affected")
        .otherwise("unchanged")
    )
    return b.join(a, key, "full_outer").withColumn("kind", kind).drop("_a", "_b")


def apply_diff(base: DataFrame, diff: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Patch: drop what the diff touches, add its new rows."""
    touched = diff.filter("kind <> 'unchanged'")
    kept = base.select(*key, *columns).join(touched.select(*key), key, "left_anti")
    new = touched.filter("kind <> 'dropped'").select(*key, *[F.col(f"after_{c}").alias(c) for c in columns])
    return kept.unionByName(new)


def change_counts(diff: DataFrame, by: list[str]) -> DataFrame:
    """Changes of each kind per group, as columns."""
    kinds = ["added", "affected", "changed", "dropped", "unchanged"]
    return diff.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def package_diff(before: DataFrame, after: DataFrame, package: str, version: str) -> DataFrame:
    """Packages that are new, dropped or updated."""
    b = before.select(F.col(package), F.col(version).alias("before_version"))
    a = after.select(F.col(package), F.col(version).alias("after_version"))
    kind = (
        F.when(F.col("before_version").isNull(), "new")
        .when(F.col("after_version").isNull(), "dropped")
        .when(F.col("before_version") != F.col("after_version"), "updated")
    )
    return b.join(a, package, "full_outer").withColumn("kind", kind).filter("kind is not null")


def map_diff(a: Column, b: Column) -> Column:
    """Entries of flag maps that differ: map of key to (before, after)."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def path_diff(a: Column, b: Column) -> Column:
    """What a set of paths gained and lost."""
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("dropped"))


def range_join(
    left: DataFrame, right: DataFrame, on: list[str], l_span: tuple[str, str], r_span: tuple[str, str], width: float, how: str = "inner"
) -> DataFrame:
    """Rows whose half-open ranges overlap, by equal bins instead of a nested loop.

    Each range is filed under all bins of ``width`` that it meets; a pair counts in the bin of
    the later start, so it comes up once. ``how``: inner, semi or anti (for the left rows).
    """

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        last = F.greatest(F.ceil(F.col(hi) / width) - 1, F.floor(F.col(lo) / width))
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), last)))

    l, r = binned(left, *l_span).alias("l"), binned(right, *r_span).alias("r")
    match = F.col("l._bin") == F.col("r._bin")
    for c in on:
        match = match & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    match = match & (F.col(f"l.{l_span[0]}") < F.col(f"r.{r_span[1]}")) & (F.col(f"r.{r_span[0]}") < F.col(f"l.{l_span[1]}"))
    once = F.col("l._bin") == F.floor(F.greatest(F.col(f"l.{l_span[0]}"), F.col(f"r.{r_span[0]}")) / width)
    if how == "inner":
        keep = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in on]
        return l.join(r, match & once).select(*keep)
    hit = l.join(r, match, "left_semi").drop("_bin").distinct()
    if how == "semi":
        return hit
    if how == "anti":
        return left.join(hit, left.columns, "left_anti")
    raise ValueError(f"unknown join {how!r}")


def covering(left: DataFrame, right: DataFrame, on: list[str], l_span: tuple[str, str], r_span: tuple[str, str]) -> DataFrame:
    """Pairs of which the left range holds all of the right one, within equal keys."""
    l, r = left.alias("l"), right.alias("r")
    match = (F.col(f"l.{l_span[0]}") <= F.col(f"r.{r_span[0]}")) & (F.col(f"l.{l_span[1]}") >= F.col(f"r.{r_span[1]}"))
    for c in on:
        match = match & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return l.join(r, match).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in on])


def shifted_by_offsets(spans: DataFrame, offsets: DataFrame, key: list[str]) -> DataFrame:
    """Spans moved by the excess of all regions of other commands that end before them.

    ``spans``: key, cmd, beg, end; ``offsets``: key, cmd, beg, end, excess. A span that meets a
    region of another command is an error.
    """
    s, o = spans.alias("s"), offsets.alias("o")
    match = F.col("s.cmd") != F.col("o.cmd")
    for c in key:
        match = match & (F.col(f"s.{c}") == F.col(f"o.{c}"))
    both = s.join(o, match & (F.col("o.beg") < F.col("s.end")), "left")
    cols = [F.col(f"s.{c}").alias(c) for c in spans.columns]
    out = both.groupBy(*cols).agg(
        F.coalesce(F.sum("o.excess"), F.lit(0)).alias("shift"), F.coalesce(F.bool_or(F.col("o.end") > F.col("s.beg")), F.lit(False)).alias("_bad")
    )
    shift = F.when(F.col("_bad"), F.raise_error(F.lit("a span overlaps a changed region"))).otherwise(F.col("shift"))
    return out.withColumn("shift", shift).withColumns({"beg": F.col("beg") + F.col("shift"), "end": F.col("end") + F.col("shift")}).drop("_bad")


def leave_one_out(changed: DataFrame, by: list[str], item: str) -> DataFrame:
    """Per changed item, the others of its group, sorted: the default change selections."""
    items = changed.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return items.select(*by, F.explode("items").alias(item), "items").select(
        *by, item, F.array_except("items", F.array(item)).alias("others")
    )


def repair_tags(command_changed: Column, proof_changed: Column, error_tags: Column) -> Column:
    """Tags of a repair: what differs, and the error's tags with a prefix."""
    own = F.array_compact(F.array(F.when(command_changed, F.lit("specification")), F.when(proof_changed, F.lit("proof"))))
    return F.array_union(
        F.transform(error_tags, lambda t: F.concat(F.lit("error:"), t)), F.transform(own, lambda t: F.concat(F.lit("repair:"), t))
    )


def nearest(left: DataFrame, right: DataFrame, on: list[str], l_value: str, r_value: str, key: str) -> DataFrame:
    """For each left row the right row of nearest value within equal keys; ties go to the lesser ``key``.

    Both sides are sorted together once and each left row looks at its right neighbours on either
    side, so the work grows with the rows, not with their product. Left rows without a partner
    are left out.
    """
    best = right.groupBy(*on, F.col(r_value).alias("_v")).agg(F.min(key).alias("_k"))
    a = left.select(*on, F.col(l_value).alias("_v"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(dict(best.dtypes)["_k"]).alias("_k"))
    b = best.select(*on, "_v", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_k")
    both = a.unionByName(b).withColumn("_r", F.when(F.col("_k").isNotNull(), F.struct("_v", "_k")))
    order = Window.partitionBy(*on).orderBy("_v")
    near = F.array(
        F.last("_r", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)),
        F.first("_r", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)),
    )
    found = both.withColumn("_near", F.array_compact(near)).filter(F.col("_l").isNotNull() & (F.size("_near") > 0))
    ranked = F.transform("_near", lambda r: F.struct(F.abs(r["_v"] - F.col("_v")).alias("d"), r["_k"].alias("k"), r["_v"].alias("v")))
    chosen = F.array_min(ranked)
    return found.select("_l.*", chosen["k"].alias(key), chosen["v"].alias(r_value))
