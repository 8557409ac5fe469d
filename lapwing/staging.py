"""Cutting lineage in loops: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one in local mode only, where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written_at(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lapwing-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again. It survives lost executors."""
    spark = df.sparkSession
    path = written_at(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, such as a loop's earlier rounds."""
    for t in tables:
        path = getattr(t, "staged_at", None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
