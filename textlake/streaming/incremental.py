"""Incremental pipelines with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlake.operators import registry


def incoming(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def register_new(stream: DataFrame, text: str, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Appends documents whose text is new to the registry at ``store``; exact over all time, as each batch is
    held against the table. A batch that is run again writes its own folder again, so nothing doubles."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(registry.content_hash(F.col(text)).alias("hash"), F.col(path).alias("file_path")).groupBy("hash").agg(F.min("file_path").alias("file_path"))
        try:
            seen = spark.read.schema("hash string, file_path string, batch long").parquet(store).where(F.col("batch") < number)
            fresh = fresh.join(seen.select("hash"), "hash", "left_anti")
        except Exception as e:  # the store is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(os.path.join(store, f"batch={number}"))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, store: str, to: str, files: int = 200) -> DataFrame:
    """Writes the registry at ``store``, one folder a batch, anew to ``to``: each hash once, in at most ``files`` files, all
    as of the last batch, so a stream with the same checkpoint goes on there. ``store`` stays as it is."""
    seen = spark.read.schema("hash string, file_path string, batch long").parquet(store)
    last = seen.agg(F.max("batch")).first()[0]
    seen.groupBy("hash").agg(F.min("file_path").alias("file_path")).coalesce(files).write.mode("overwrite").parquet(os.path.join(to, f"batch={last}"))
    return spark.read.schema("hash string, file_path string, batch long").parquet(to)


def distinct_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Copies that arrive within ``delay`` go; the state is bounded by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(df: DataFrame, at: str, width: str, *keys: str, value: str, delay: str | None = None) -> DataFrame:
    """Count and sum by time window; the same plan for batch and, with a watermark, for streams."""
    df = df.withWatermark(at, delay) if delay else df
    g = df.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, key: str, at: str, gap: str, delay: str | None = None) -> DataFrame:
    df = df.withWatermark(at, delay) if delay else df
    g = df.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), "n")


def unprocessed(docs: DataFrame, done: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows that have no result yet; at most ``most`` a run, lowest keys first."""
    todo = docs.join(done.select(key), key, "left_anti")
    return todo.orderBy(key).limit(most) if most else todo


def lacking(df: DataFrame, column: str, key: str, most: int = 1000) -> DataFrame:
    """Rows whose ``column`` is null or empty (a text or a list), at most ``most`` a run, lowest keys first."""
    c = F.col(column)
    empty = c == "" if df.schema[column].dataType.typeName() == "string" else F.size(c) == 0
    return df.where(c.isNull() | empty).orderBy(key).limit(most)
