"""Set operations by row and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def set_union(*tables: DataFrame) -> DataFrame:
    return bag_union(*tables).distinct()


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b has not."""
    return a.join(b.select(key), key, "left_anti")


def seed_allocators(official: DataFrame, found: DataFrame) -> DataFrame:
    return set_union(official.select("funcname"), found.select("funcname"))


def seed_deallocators(official: DataFrame, found: DataFrame) -> DataFrame:
    return bag_union(official.select("funcname", "arg_index"), found.select("funcname", "arg_index"))


def add_primitives(normal: DataFrame, customised: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds that free their first argument are normal, others customised at that argument."""
    first = seeds.where("arg_index = 0").select("funcname")
    pair = F.array(F.struct(F.col("arg_index").alias("idx"), F.lit("map").alias("name")))
    others = seeds.where("arg_index <> 0").select("funcname", pair.alias("params"), F.array().cast("array<struct<idx:int,name:string>>").alias("members"))
    return bag_union(normal.select("funcname"), first), bag_union(customised.select("funcname", "params", "members"), others)


def distinct_by_name(*tables: DataFrame, key: str = "funcname", lower: bool = True) -> DataFrame:
    """Union of label files, one row for each (lower-cased) name; earlier files win."""
    from lapwing.operators.lookups import prioritised

    if lower:
        tables = tuple(t.select(*[F.lower(c).alias(c) if kind == "string" else F.col(c) for c, kind in t.dtypes]) for t in tables)
    return prioritised(*tables, key=key)
