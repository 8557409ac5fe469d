"""Small helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch: a batch of whole texts stays well below a worker's memory, however long they are.
ARROW_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one in local mode only, where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors: what later jobs read is a
    committed table, not a cached block. Void columns cannot be stored in Parquet,
    so callers pass typed columns only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lapwing-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, such as a loop's earlier rounds."""
    for t in tables:
        path = getattr(t, "staged_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes that one Arrow batch can hold, unless the session has a lower bound.

    The plan reads the setting when it runs, so it can't be put back before. Rows in a
    batch are left as the session has them.
    """
    if spark.conf.get(_BATCH_KEY, None) is None or _bytes(spark.conf.get(_BATCH_KEY)) > size:
        spark.conf.set(_BATCH_KEY, str(size))


def _bytes(setting: str) -> int:
    digits = "".join(c for c in setting if c.isdigit() or c == "-")
    unit = setting.strip().lower().rstrip("b")[-1:]
    n = int(digits) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)
    return n if n > 0 else 1 << 62


def repeated_ids(ids: DataFrame) -> DataFrame | None:
    """The doc_ids (column _again) that stand in more than one row of ``ids``, null too; None if there are none."""
    again = staged(ids.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1 OR _again IS NULL").select("_again"), "repeated-ids")
    return None if again.isEmpty() else again


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
