"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HOT_PARTS = 512
HOT_ROWS = 256
FILE_ROWS = 1 << 16
FEW_FILES = 8


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share, spark.checkpoint.dir.

    Only where the setting is absent on one machine (tests) is a folder made and set; on a
    cluster its absence is an error, since executors can't see each other's local folders.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return os.path.join(folder, context.applicationId)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written between steps. Results that still read them can't be computed any more."""
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, most: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table: the lineage ends here.

    most bounds the number of rows where that is known (rows of a few numbers, no texts). A small table is then
    gathered into a file for FILE_ROWS rows instead of one for each task: for a new file Hadoop may start
    a process of its own, which for a moment counts as much memory as the executor.
    """
    spark = session(df)
    if most is not None and most <= FILE_ROWS * FEW_FILES:
        df = df.repartition(max(1, -(-most // FILE_ROWS)))
    path = os.path.join(shared_folder(spark), f"t-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """The keys with at least 1 / HOT_PARTS of the rows: at most HOT_PARTS of them."""
    total = left.count()
    return settle(left.groupBy(key).agg(F.count("*").alias("held__")).where(F.col("held__") >= max(HOT_ROWS, total / HOT_PARTS)).select(key), HOT_PARTS)


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join with a table of distinct keys in which no key's rows have to meet in one task.

    Hot keys number at most HOT_PARTS, so their rows of the right table are broadcast; all other
    keys are shuffled. left is read several times: give a written table.
    """
    found = settle((hot or hot_keys(left, key)).join(right, key, "left"), HOT_PARTS)
    near = left.join(F.broadcast(found), key)
    far = left.join(F.broadcast(found.select(key)), key, "left_anti").join(right, key, "left")
    return near.unionByName(far)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None  # another C library
_tables: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """Where an operator keeps large tables in a Python worker from task to task; tasks of other operators empty it."""
    return _tables.setdefault(owner, {})


def forget(owner: str | None = None) -> None:
    """Empty the tables of all operators but ``owner``."""
    for name, kept in _tables.items():
        if name != owner:
            kept.clear()


def give_back() -> None:
    """Give freed memory back to the system: that of Arrow's pool and, with glibc, that of malloc."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable, owner: str | None = None) -> Callable:
    """A function for mapInArrow that leaves its worker small.

    A Python worker outlives its task and waits for the next, of any operator. What an operator before has
    kept there, and what each batch has freed, would count as the executor's memory meanwhile.
    """

    def task(batches):
        def each():
            for batch in batches:
                yield batch
                give_back()

        forget(owner)
        try:
            yield from run(each())
        finally:
            give_back()

    return task


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def uniform(column: str = "doc_id", salt: str = "sample"):
    """A fixed pseudo-random value in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 30)) / float(1 << 30)


def plain(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the named columns; other columns are not read."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
