"""Structured Streaming over append logs.  An extension: the batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_stream(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_per_key(stream: DataFrame, *, key: str, when: str, delay: str = "1 day") -> DataFrame:
    """First record of each key within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, *, when: str, category: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``start, end, category, n`` per window; late rows count until the watermark has passed."""
    w = F.window(when, width)
    return stream.withWatermark(when, delay).groupBy(w.alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("n")).select("w.start", "w.end", "category", "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """A running query that appends to Parquet; exactly once through the checkpoint folder."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(urls: DataFrame, processed: DataFrame, *, url: str = "url") -> DataFrame:
    """URLs that are neither a final nor a request URL of what has been processed."""
    done = processed.select(F.explode(F.array("final_url", "request_url")).alias(url)).filter(F.col(url).isNotNull()).distinct()
    return urls.join(done, url, "left_anti")
