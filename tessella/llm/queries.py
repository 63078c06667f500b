"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load
from . import bpe, capfilter, dartminhash, exacthash, langid, ordinal, packing, sql, suffixlevels, urltrie, warc

URL_RULES: list[urltrie.Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def vocabulary() -> str:
    """Path of the public vocabulary file; every executor has it installed."""
    return public_tokenizers.path("byte_bpe_50k.json")


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> ordinal.CumulativeLink:
    """The quality classifier, fitted to the ratings table."""
    rated = load(spark, sf_dir, "labels")
    graded = rated.select("doc_id", ordinal.grade_of(rated["quality"], rated["toxic"]).alias("grade"))
    return ordinal.train(docs, graded)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return ordinal.score(docs, quality_model(docs, spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exacthash.exact_dedup(load(spark, sf_dir, "documents")).drop("bucket", "page", "link")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlevels.repeated_bytes(load(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrie.judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), vocabulary())


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(load(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(load(spark, sf_dir, "documents")).drop("class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_warc, op3_exact_dedup, op4_language_id, op5_packing, op6_suffix_dedup, op7_url_filter, op8_bpe, op9_cap_filters, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
