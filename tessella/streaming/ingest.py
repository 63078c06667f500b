"""Structured Streaming ingest (an extension): resumable intake of cache objects and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(df: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key; keys are forgotten once the watermark has passed them."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed(df: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window."""
    w = F.window(ts, width)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per session: events closer than the gap."""
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


def append_new(df: DataFrame, path: str, key: list[str], checkpoint: str, partitions: list[str] | None = None) -> StreamingQuery:
    """Append rows whose key the table lacks; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        try:
            known = spark.read.parquet(path).select(*key)
        except Exception as e:  # the table's first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(known, key, "left_anti")
        new.write.mode("append").partitionBy(*(partitions or [])).parquet(path)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
