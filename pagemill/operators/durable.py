"""Lineage cuts: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pagemill-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder, else one of our own (local sessions only). The session isn't changed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder()
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df, "cut")


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which goes when the driver's process ends."""
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone already
        pass
