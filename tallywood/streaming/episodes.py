"""Streaming forms: episodes as session windows, and file ingest with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def streaming_episodes(facts: DataFrame, window_days: int, lateness: str = "7 days") -> DataFrame:
    """Episodes of a stream of facts (event time obs_time) for concepts of one window of at least a day.

    Days exactly the window apart belong together, as in the batch form; rows later than the
    watermark are dropped by Spark and show up in the query's progress.
    """
    return facts.withWatermark("obs_time", lateness).groupBy("subject", "concept", F.session_window("obs_time", f"{window_days} days").alias("span")).agg(F.count("*").alias("n_facts"), F.min("value").alias("low"), F.max("value").alias("high"))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as they arrive; resuming is the checkpoint's matter."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))
