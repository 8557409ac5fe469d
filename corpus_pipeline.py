"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before has kept. ``run`` writes every stage's result
as Parquet to the folder that driver and executors share and reads it again, so no
stage is worked out twice and a lost executor costs its own tasks only.

Every stage but the last gives back rows of its input with their own columns, whatever
they are called. Null and empty texts are rejected by the quality rules; in the later
stages, which can be run alone, they are texts like any other. Repeated rows and rows
that share a doc_id are rows of their own: quality, personal data and packing treat each
by its text, the two dedup stages keep one of each group, whatever its id. Ties are
broken by doc_id, and without one by the order of the rows. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapwing.llm import exact, packing, pii, quality, simhash
from lapwing.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null and empty texts."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z and a-z) one row stays, that of the largest doc_id."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies one row stays, that of the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts and their places in sequences; a null text is a closing token."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("pii", mask_pii), ("packing", pack)]

#: The rows depend on models fitted by EM and on a packing heuristic, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
