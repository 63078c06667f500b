"""File formats: JSON, JSON lines, YAML, CSV and text, plain or compressed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions of formats and codecs.
FORMATS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yml": "yaml", "yaml": "yaml", "csv": "csv", "txt": "text", "parquet": "parquet"}
CODECS = {"gz": "gzip", "bz2": "bzip2", "zst": "zstd"}


def infer_format(path: str) -> tuple[str, str | None]:
    """(format, codec) by a file's extensions."""
    parts = [s[1:].lower() for s in PurePosixPath(path.rstrip("/")).suffixes]
    codec = CODECS.get(parts[-1]) if parts else None
    if codec:
        parts = parts[:-1]
    if not parts or parts[-1] not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[parts[-1]], codec


def read(spark: SparkSession, path: str, schema: str | None = None, fmt: str | None = None) -> DataFrame:
    """Read files by their format; without a schema JSON is inferred and CSV stays text."""
    fmt = fmt or infer_format(path)[0]
    reader = spark.read.schema(schema) if schema and fmt != "yaml" else spark.read
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if fmt == "text":
        return spark.read.text(path)
    if fmt == "yaml":
        if schema is None:
            raise ValueError("YAML needs a schema")
        return read_yaml(spark, path, schema)
    return reader.parquet(path)


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per YAML document (or item of a list); needs the yaml package on the workers."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            rows = []
            for content in part["content"]:
                for doc in yaml.safe_load_all(content):
                    rows += [json.dumps(x) for x in (doc if isinstance(doc, list) else [doc])]
            yield pd.DataFrame({"value": rows})

    parsed = files.mapInPandas(load, "value string").select(F.from_json("value", schema).alias("r"))
    return parsed.select("r.*")


def write(df: DataFrame, path: str, fmt: str | None = None, codec: str | None = None, mode: str = "error") -> None:
    """Write a folder of files; the commit protocol makes them visible at once."""
    if fmt is None:
        fmt, codec = infer_format(path)
    writer = df.write.mode(mode)
    if codec:
        writer = writer.option("compression", codec)
    if fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "text":
        writer.text(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"{fmt} can't be written")


def find_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, bytes) of files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("length").alias("bytes"))


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line) of text files."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def source_files(files: DataFrame, path: str, ignore: list[str], suffix: str = ".v") -> DataFrame:
    """Files of a project by name, without those that a pattern (anchored at the start) matches."""
    keep = F.col(path).endswith(suffix)
    for pattern in ignore:
        keep = keep & ~F.col(path).rlike(f"^(?:{pattern})")
    return files.filter(keep).orderBy(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, project) of a file that maps splits to lists of projects."""
    text = spark.read.option("wholetext", True).text(path)
    splits = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(splits).alias("split", "projects")).select("split", F.explode("projects").alias("project"))


def file_texts(commands: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Contents of each file from its commands in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t"))))
    return commands.groupBy(*by).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["t"]), "\n"), F.lit("\n")).alias("contents"))
