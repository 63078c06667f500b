"""The extraction cache as a partitioned table: project / commit / version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["project", "commit_hash", "coq_version"]
#: Versions that are scanned by default.
VERSIONS = ["8.9.1", "8.10.2", "8.11.2", "8.12.2", "8.13.2", "8.14.1", "8.15.2"]
EVENTS = "project string, commit_hash string, coq_version string, kind string, ts timestamp, message string"


def write(df: DataFrame, path: str) -> None:
    """Write objects; only partitions that occur are replaced, and readers see whole files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All objects; filters on project, commit and version prune directories."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("inferSchema", False).parquet(path)


def projects(cache: DataFrame) -> DataFrame:
    return cache.select("project").distinct()


def commits(cache: DataFrame) -> DataFrame:
    return cache.groupBy("project").agg(F.array_sort(F.collect_set("commit_hash")).alias("commits"))


def status(
    cache: DataFrame, projects: list[str] | None = None, commits: DataFrame | None = None, versions: list[str] | None = None
) -> DataFrame:
    """Statuses of objects, with optional allow-lists; a null list lets all pass, versions default to ``VERSIONS``."""
    out = cache.filter(F.col("coq_version").isin(versions if versions is not None else VERSIONS))
    if projects is not None:
        out = out.filter(F.col("project").isin(projects))
    if commits is not None:
        out = out.join(commits.select("project", "commit_hash"), ["project", "commit_hash"], "left_semi")
    return out


def get(cache: DataFrame, project: str, commit_hash: str, coq_version: str) -> DataFrame:
    """One object, by a scan of its partition."""
    return cache.filter((F.col("project") == project) & (F.col("commit_hash") == commit_hash) & (F.col("coq_version") == coq_version))


def contains(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(cache.select(*PARTITIONS), PARTITIONS, "left_semi")


def append_events(df: DataFrame, path: str) -> None:
    """Error, timing and worker logs."""
    df.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.mode("append").parquet(path)


def without_errors(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Log without the errors of keys that succeeded."""
    errors = events.filter(F.col("kind").endswith("error"))
    return events.filter(~F.col("kind").endswith("error")).unionByName(errors.join(keys.select(*PARTITIONS), PARTITIONS, "left_anti"))


def pending(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that are still to be extracted."""
    return requested.join(cache.select(*PARTITIONS), PARTITIONS, "left_anti")
