"""Exact dedup with a heavy-hitter split.

Texts are compared by the SHA-256 of the text with A-Z lower-cased. While the
digests are made, each task keeps a Misra-Gries summary of those it has seen: any
digest with more than n / (counters + 1) of a task's n rows is in that task's
summary, so a digest with more than that share of all rows is in one of them. The
summaries are merged to at most ``counters`` candidates, which one map-side
aggregate counts exactly. The verified winners are broadcast (their number is bound
by ``counters``) and settle their rows without a shuffle; all other digests, now
known to be of bounded share, are grouped by an ordinary shuffle.

Defined results: a null text counts as an empty one; of equal texts the row with
the largest doc_id stays (repeated rows with one doc_id share its verdict); an empty table
gives an empty result. A null doc_id counts as smaller than any other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.llm.common import repeated_ids, small_arrow_batches, staged, table, text_or_empty

#: Misra-Gries counters of a task, and the bound of the merged candidates.
COUNTERS = 1024


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class MisraGries:
    def __init__(self, counters: int):
        self.counters, self.n, self.counts = counters, 0, {}

    def add(self, keys) -> None:
        counts = self.counts
        for k in keys:
            self.n += 1
            if k in counts:
                counts[k] += 1
            elif len(counts) < self.counters:
                counts[k] = 1
            else:
                self.counts = counts = {x: c - 1 for x, c in counts.items() if c > 1}


def digests(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, n): a row for each document with n null, and after them the
    counters of each task's summary, with doc_id null and n their count."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        summary = MisraGries(counters)
        for b in batches:
            sha = [hashlib.sha256(t.lower()).digest() for t in b.column(1).to_pylist()]  # bytes.lower changes A-Z only
            summary.add(sha)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.nulls(len(sha), pa.int64())], names=["doc_id", "digest", "n"])
        left = list(summary.counts.items())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array([k for k, _ in left], pa.binary()), pa.array([c for _, c in left], pa.int64())], names=["doc_id", "digest", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n long")


def heavy_candidates(summaries: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Merge summaries: add the counters of a digest, then take from each of the
    largest ``counters`` what the next one has left. At most ``counters`` digests."""
    top = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    floor = top[counters]["n"] if len(top) > counters else 1
    return [bytes(r["digest"]) for r in top[:counters] if r["n"] > floor]


def resolve(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """From what ``digests`` gave: doc_id, digest, keep_id, group_size, kept."""
    spark = rows.sparkSession
    docs = rows.filter("n IS NULL").select("doc_id", "digest")
    found = heavy_candidates(rows.filter("n IS NOT NULL"), counters)
    heavy = spark.createDataFrame([(bytearray(d),) for d in found], T.StructType([T.StructField("digest", T.BinaryType())]))
    # exact counts of the candidates, each task sums at most `counters` keys before the shuffle
    winners = docs.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = docs.join(F.broadcast(winners), "digest")
    w = Window.partitionBy("digest")
    rest = docs.join(F.broadcast(heavy), "digest", "left_anti").select("*", F.max("doc_id").over(w).alias("keep_id"), F.count(F.lit(1)).over(w).alias("group_size"))
    both = settled.select(*rest.columns).unionByName(rest)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    done = resolve(staged(digests(docs, counters), "digests"), counters)
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One document of each group of equal texts, with its own columns.

    Documents are found again by their doc_id. Rows that share one, or have none, are told
    apart by the digest of their text, and of equal ones the one with the first row stays.
    """
    rows = staged(digests(docs, counters), "digests")
    done = resolve(rows, counters).where("kept").select(F.col("doc_id").alias("_stays"), F.lower(F.hex("digest")).alias("_digest"))
    id_ = F.col("doc_id").cast("long")
    again = repeated_ids(rows.where("n IS NULL").select("doc_id"))
    if again is None:
        return docs.join(done.select("_stays"), id_ == F.col("_stays"), "left_semi")
    done = staged(done.distinct(), "kept-texts")
    single = docs.join(again, id_.eqNullSafe(F.col("_again")), "left_anti").join(done.select("_stays"), id_ == F.col("_stays"), "left_semi")
    own = docs.join(again, id_.eqNullSafe(F.col("_again")), "left_semi").withColumn("_own", F.sha2(F.translate(text_or_empty(), _UPPER, _UPPER.lower()).cast("binary"), 256))
    kept = own.join(done, F.col("_own").eqNullSafe(F.col("_digest")) & id_.eqNullSafe(F.col("_stays")), "left_semi")
    return single.unionByName(_one_of_each(kept, "_own", docs.columns))


def _one_of_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key, with the columns; each task picks its own first."""
    picked = rows.groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))
    return picked.select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
