"""Loading of the engine's Parquet tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
HOME = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That suffices where workers see the driver's folder; elsewhere submit the package with
    ``--py-files``, which takes precedence.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), HOME])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; ``sf_dir`` may be any path or URI that Spark can read."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
