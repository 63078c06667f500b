"""Training-corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import dartminhash, exacthash, ordinal, packing, suffixlevels
from tessella.llm.queries import quality_model, vocabulary
from tessella.llm.shared import drop_folder, mark, new_folder, release, written
from tessella.sources.tables import importable, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to the ratings table, doesn't reject."""
    importable(spark)
    return ordinal.select(docs, quality_model(docs, spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exacthash.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 of five-word shingles."""
    importable(spark)
    return dartminhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte passages that also start elsewhere."""
    importable(spark)
    kept = suffixlevels.remove_repeats(docs)
    if "n_chars" not in kept.columns:
        return kept
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    importable(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Hash signatures and a fitted classifier have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole documents table."""
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since, at = mark(), new_folder(spark, "stage-" + name.split()[0].lower())
        docs = written(stage(spark, docs, sf_dir), name, at)
        release(spark, since, keep=at)
        if last:
            drop_folder(spark, last)
        last = at
    return docs
