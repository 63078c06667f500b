"""Index of mined records: unique by a natural key, numbered, with canonical file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import version_to_path
from .sequences import numbered

#: Natural key of a record.
KEY = [
    "project_name",
    "initial_commit_sha",
    "repaired_commit_sha",
    "initial_coq_version",
    "repaired_coq_version",
    "added_commands",
    "affected_commands",
    "changed_commands",
    "dropped_commands",
]
PAIR = KEY[:5]
SCHEMA = "id long, " + ", ".join(f"{k} string" for k in KEY) + ", file_name string"


def file_name(index: Column) -> Column:
    """``project-initial-repaired-versions-index`` with its suffix."""
    parts = [
        F.col("project_name"),
        F.col("initial_commit_sha"),
        F.col("repaired_commit_sha"),
        version_to_path(F.col("initial_coq_version")),
        version_to_path(F.col("repaired_coq_version")),
        index.cast("string"),
    ]
    return F.concat(F.concat_ws("-", *parts), F.lit(".json"))


def insert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with those new records that it lacks; ids and file names go on from what is there.

    Ids are places in the order of the key, offset by the greatest id; names count within a
    commit pair. Records that repeat a key, in the index or among the new ones, are left out.
    """
    fresh = new.select(*KEY).dropDuplicates(KEY).join(index.select(*KEY), KEY, "left_anti")
    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    used = index.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("used"))
    placed = numbered(fresh, KEY, "_place", start=1)
    within = F.row_number().over(Window.partitionBy(*PAIR).orderBy("_place")) - 1
    out = placed.withColumn("_n", within).join(used, PAIR, "left").crossJoin(F.broadcast(top))  # top is one row
    out = out.withColumn("id", F.col("top") + F.col("_place"))
    out = out.withColumn("file_name", file_name(F.coalesce("used", F.lit(0)) + F.col("_n")))
    return index.select("id", *KEY, "file_name").unionByName(out.select("id", *KEY, "file_name"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union of indexes on the natural key, numbered anew; the first index that has a record decides its place."""
    tagged = [p.select("id", *KEY).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    first = both.groupBy(*KEY).agg(F.min(F.struct("_part", "id")).alias("_at"))
    pair = Window.partitionBy(*PAIR).orderBy("_at")
    named = first.withColumn("_n", F.row_number().over(pair) - 1).withColumn("file_name", file_name(F.col("_n")))
    return numbered(named, ["_at"], "id", start=1).select("id", *KEY, "file_name")


def by_pair(index: DataFrame, **values: str) -> DataFrame:
    """Records with the given key values, by id."""
    out = index
    for k, v in values.items():
        out = out.filter(F.col(k) == v)
    return out.orderBy("id")


def get_one(index: DataFrame, **values: str) -> DataFrame:
    """The record with a key; several are an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    found = by_pair(index, **values).limit(2).withColumn("_n", n)
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("several records have this key"))).otherwise(F.col("id"))
    return found.withColumn("id", checked.cast("long")).drop("_n")
