"""Mining of repairs: from aligned snapshots to broken states, repairs and their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import snapshots as P

KEY = ["pair", "file", "idx"]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classified commands of commit pairs: ``before`` and ``after`` hold (pair, file, idx, text, proof), aligned by idx."""
    return P.snapshot_diff(before, after, KEY, "text", ["proof"])


def changesets(diff: DataFrame) -> DataFrame:
    """One selection per changed command: it stays broken while all other changes are made."""
    where = F.struct("file", "idx")
    of = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, where))).alias(k) for k in ("added", "affected", "changed", "dropped")}
    sets = diff.groupBy("pair").agg(*of.values()).filter(F.size("changed") > 0)
    one = sets.withColumn("broken", F.explode("changed"))
    return one.withColumn("changed", F.array_except("changed", F.array("broken")))


def broken_states(before: DataFrame, diff: DataFrame, sets: DataFrame) -> DataFrame:
    """Commands of each broken state: the later snapshot with the broken command as it was.

    The broken command keeps its text and proof and takes the place of its repair.
    """
    later = diff.filter("kind <> 'dropped'").select(*KEY, F.col("after_text").alias("text"), F.col("after_proof").alias("proof"))
    at = sets.select("pair", F.col("broken.file").alias("b_file"), F.col("broken.idx").alias("b_idx"))
    rows = later.join(at, "pair")
    old = before.select("pair", F.col("file").alias("b_file"), F.col("idx").alias("b_idx"), F.col("text").alias("old_text"), F.col("proof").alias("old_proof"))
    rows = rows.join(old, ["pair", "b_file", "b_idx"])
    hit = (F.col("file") == F.col("b_file")) & (F.col("idx") == F.col("b_idx"))
    return rows.select(
        "pair",
        "b_file",
        "b_idx",
        "file",
        "idx",
        F.when(hit, F.col("old_text")).otherwise(F.col("text")).alias("text"),
        F.when(hit, F.col("old_proof")).otherwise(F.col("proof")).alias("proof"),
        hit.alias("broken"),
    )


def repairs(before: DataFrame, after: DataFrame, error_tags: DataFrame | None = None) -> DataFrame:
    """Repairs of all pairs: place, broken and repaired text, tags; ``error_tags``: (pair, tags) if there are any."""
    diff = changes(before, after).filter("kind in ('changed', 'affected')")
    if error_tags is None:
        tagged = diff.withColumn("tags", F.array().cast("array<string>"))
    else:
        tagged = diff.join(error_tags, "pair", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    text = ~F.col("before_text").eqNullSafe(F.col("after_text"))
    proof = ~F.col("before_proof").eqNullSafe(F.col("after_proof"))
    return tagged.select(
        *KEY,
        F.col("before_text").alias("broken_text"),
        F.col("after_text").alias("repaired_text"),
        F.col("before_proof").alias("broken_proof"),
        F.col("after_proof").alias("repaired_proof"),
        P.repair_tags(text, proof, F.col("tags")).alias("tags"),
    )


def filtered(found: DataFrame, tags: list[str]) -> DataFrame:
    """Repairs with any of the tags; without tags all."""
    return found.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else found
