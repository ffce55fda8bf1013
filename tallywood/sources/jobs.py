"""Bulk jobs: files read a chunk at a time, each chunk committed as a whole, resumable after a kill at any point.

A job's folder holds manifest (one item for each file, numbered by path, written before any file is
read), ledger and documents (a folder for each chunk) and the stream's checkpoint. A chunk is a micro-batch of a file
stream with Trigger.AvailableNow. It writes its documents, then its ledger entries, into folders named by its number,
so a chunk that is run again after a kill replaces what it had begun. A document counts only if its chunk's ledger is there.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import described, parse_files, plan_job, raw_text
from .tables import settle

#: Fixed value: files in a chunk.
CHUNK_FILES = 200
_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
_LEDGER = "job_id string, ordinal long, path string, status string, error string, duplicate_of string, sha256 string, byte_size long, chunk long"


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def plan(spark: SparkSession, folder: str, job: str, job_id: str) -> DataFrame:
    """The job's manifest; written on the first call and read on later ones."""
    path = os.path.join(job, "manifest")
    if not _is_there(spark, os.path.join(path, "_SUCCESS")):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content").withColumn("content", F.lit(b""))
        plan_job(described(listed), job_id).drop("sha256").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ledger(spark: SparkSession, job: str) -> DataFrame:
    """Items of the chunks committed so far."""
    path = os.path.join(job, "ledger")
    if not _is_there(spark, path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def documents(spark: SparkSession, job: str) -> DataFrame | None:
    """Documents of the chunks committed so far, or None before the first."""
    path = os.path.join(job, "documents")
    if not _is_there(spark, path):
        return None
    return spark.read.parquet(path).join(F.broadcast(ledger(spark, job).select("chunk").distinct()), "chunk", "left_semi")  # a row for each chunk


def status(spark: SparkSession, job: str) -> DataFrame:
    """The manifest with each item's status: PENDING until its chunk is committed. Readable while the job runs."""
    done = ledger(spark, job).select("job_id", "ordinal", F.col("status").alias("done__"))
    rows = spark.read.parquet(os.path.join(job, "manifest")).join(done, ["job_id", "ordinal"], "left")
    return rows.withColumn("status", F.coalesce("done__", "status")).drop("done__")


def run_job(spark: SparkSession, folder: str, job: str, job_id: str, chunk_files: int = CHUNK_FILES, after_chunk: Callable[[int], None] | None = None) -> DataFrame:
    """Run or resume a job until nothing is pending; the counts of its items. after_chunk sees each committed chunk's number.

    The first document of a content in the job is kept, in the order of chunks and then of paths; later ones are DUPLICATE
    entries of the ledger. A file that can't be read is a FAILED entry and stops nothing.
    """
    manifest = plan(spark, folder, job, job_id)

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        files = described(batch).withColumn("case_id", F.lit(job_id))
        parsed = settle(raw_text(parse_files(files)))  # read, hashed and parsed once
        known = documents(session, job)
        if known is not None:
            earlier = known.where(F.col("chunk") < number).select("sha256", F.col("path").alias("kept__"))
            parsed = parsed.join(earlier, "sha256", "left")
            again = F.col("kept__").isNotNull() & F.col("status").isin("INGESTED", "MISSING", "DUPLICATE")
            parsed = parsed.withColumns({"status": F.when(again, "DUPLICATE").otherwise(F.col("status")), "duplicate_of": F.coalesce("kept__", "duplicate_of")}).drop("kept__")
        kept = parsed.where(F.col("status").isin("INGESTED", "MISSING"))
        kept.select("path", "suffix", "byte_size", "sha256", "pages", "raw_text", "page_offsets", "text_sha256", "char_count", "status").write.mode("overwrite").parquet(os.path.join(job, "documents", f"chunk={number}"))
        items = parsed.join(manifest.select("path", "ordinal"), "path").select(F.lit(job_id).alias("job_id"), F.col("ordinal").cast("long"), "path", "status", "error", "duplicate_of", "sha256", "byte_size")
        items.write.mode("overwrite").parquet(os.path.join(job, "ledger", f"chunk={number}"))
        if after_chunk:
            after_chunk(number)

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", chunk_files).load(folder)
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", os.path.join(job, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return status(spark, job).groupBy("job_id", "status").agg(F.count("*").alias("n"))
