"""Where a plan is cut: results kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="cairn-"))
    return where or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the folder of ``spark.checkpoint.dir``; a temporary one where all runs on this machine."""
    _folder(df.sparkSession)
    return df.checkpoint()
