"""Sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _uniform(key: Column, seed: int) -> Column:
    """Number in (0, 1) that depends on key and seed only, so a retried task draws the same."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, with chances in proportion to their weights (exponential keys)."""
    draw = -F.log(_uniform(F.col(key), seed)) / weight
    return df.filter(weight > 0).orderBy(draw, key).limit(n)


def random_row(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, each as likely as another."""
    return df.orderBy(_uniform(F.col(key), seed), key).limit(1)


def random_pair(df: DataFrame, by: list[str], order: list[str], key: str, seed: int = 0) -> DataFrame:
    """One row that has a successor, with the successor's key."""
    w = Window.partitionBy(*by).orderBy(*order)
    pairs = df.withColumn(f"next_{key}", F.lead(key).over(w)).filter(F.col(f"next_{key}").isNotNull())
    return random_row(pairs, key, seed)


def split(groups: DataFrame, key: str, size: str, targets: dict[str, float], first: str = "train", seed: int = 2) -> DataFrame:
    """(key, split): the largest group goes to ``first``; the others fill the targets in a seeded order.

    The groups are few compared to rows (one row per project group); sizes are summed in one
    window over them. The shares come out within the size of one group of their targets.
    """
    total = Window.partitionBy()
    order = Window.orderBy(F.col("_top").desc(), "_draw", key)
    top = F.row_number().over(Window.orderBy(F.col(size).desc(), key)) == 1
    df = groups.select(key, size).withColumn("_top", top).withColumn("_draw", _uniform(F.col(key), seed))
    df = df.withColumn("_upto", (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size) / 2) / F.sum(size).over(total))
    out, edge = F.when(F.col("_top"), first), 0.0
    names = [first, *(n for n in targets if n != first)]
    for name in names[:-1]:
        edge += targets[name]
        out = out.when(F.col("_upto") <= edge, name)
    return df.select(key, size, out.otherwise(names[-1]).alias("split"))
