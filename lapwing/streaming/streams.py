"""Structured Streaming forms: append-only logs, visited sets, compaction, symbol state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapwing.operators.summaries import calls_by_name
from lapwing.staging import dropped, remove, staged


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines that concurrent writers append as new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_visits(stream: DataFrame, key: str = "funcname") -> DataFrame:
    """One row for each name, the first that arrives; names are the state."""
    return stream.dropDuplicates([key])


_EDGES = "caller string, pos long, nth long, callee string, number long, bucket int"


def _manifest(spark: SparkSession, target: str, epoch: int) -> dict[int, str]:
    """The folder of each bucket's rows after a batch; a row for each of the buckets."""
    rows = spark.read.schema("bucket int, path string").parquet(f"{target}/manifest/{epoch}").collect() if epoch >= 0 else []
    return {r["bucket"]: r["path"] for r in rows}


def _rows_of(spark: SparkSession, paths) -> DataFrame:
    paths = sorted(paths)
    return spark.read.schema(_EDGES).parquet(*paths) if paths else spark.createDataFrame([], _EDGES)


def compacted_table(spark: SparkSession, target: str, epoch: int) -> DataFrame:
    """(caller, callee, number) of the best groups after batch ``epoch``."""
    return _rows_of(spark, _manifest(spark, target, epoch).values()).select("caller", "callee", "number")


def compacting_writer(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64):
    """Merge each batch of (caller, pos, nth, callee, number) rows into a table of the best groups.

    Callers are dealt into buckets by hash. A batch reads and rewrites the buckets of its
    own callers only, to folders of its own; the manifest, written last, says where each
    bucket's rows are, so a batch that is tried again gives the same table. Folders that
    the manifests of this batch and the one before don't name are deleted.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, target, epoch - 1)
        number = F.coalesce(F.col("number").cast("long"), F.lit(1))
        fresh = batch.select("caller", F.col("pos").cast("long").alias("pos"), F.col("nth").cast("long").alias("nth"), "callee", number.alias("number"), F.pmod(F.hash("caller"), F.lit(buckets)).alias("bucket"))
        fresh = staged(fresh, "batch")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        rows = fresh.unionByName(_rows_of(spark, {before[b] for b in touched if b in before}))
        counted = calls_by_name(rows).withColumn("nth", F.lit(0).cast("long"))
        sizes = counted.groupBy("caller", "pos").agg(F.count("*").alias("n"))
        best = sizes.groupBy("caller").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"))
        out = counted.join(best, ["caller", "pos"], "left_semi").withColumn("bucket", F.pmod(F.hash("caller"), F.lit(buckets)))
        out = out.select("caller", "pos", "nth", "callee", "number", "bucket", F.col("bucket").alias("part"))
        out.write.mode("overwrite").partitionBy("part").parquet(f"{target}/rows/{epoch}")
        now = before | {b: f"{target}/rows/{epoch}/part={b}" for b in touched}
        spark.createDataFrame(list(now.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{epoch}")
        dropped(fresh)
        for path in set(_manifest(spark, target, epoch - 2).values() if epoch > 1 else ()) - set(now.values()) - set(before.values()):
            remove(spark, path)
        if epoch > 1:
            remove(spark, f"{target}/manifest/{epoch - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


_BUGS = "path_id long, sym string, seq long, bug string"


def _states(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get[0] if state.exists else ""
    rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
    out = []
    for seq, op in zip(rows["seq"], rows["op"], strict=True):
        if held == "released" and op in ("free", "use"):
            out.append((key[0], key[1], seq, "double_free" if op == "free" else "use_after_free"))
        held = "allocated" if op == "alloc" else "released" if op == "free" else held
    state.update((held,))
    yield pd.DataFrame(out, columns=["path_id", "sym", "seq", "bug"])


def symbol_bugs(events: DataFrame) -> DataFrame:
    """Double frees and uses after free in a stream of (path_id, sym, seq, op).

    A symbol's state is one word. Events of a symbol must arrive in order of seq between
    batches; within a batch they are sorted.
    """
    return events.groupBy("path_id", "sym").applyInPandasWithState(_states, _BUGS, "held string", "append", GroupStateTimeout.NoTimeout)
