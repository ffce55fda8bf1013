"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only on one machine (local masters) is a folder made where the setting is absent."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return os.path.join(folder, context.applicationId)


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows and go on from the written table: the lineage ends here, and a lost executor costs no earlier step."""
    path = path or os.path.join(shared_folder(df.sparkSession), f"e-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
