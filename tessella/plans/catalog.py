"""Registry of the engine's queries and of their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import domain, ordered, relational, statistics  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns of each conversation with the normalised edit distance of their texts."""
    return relational.adjacent_distance(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
