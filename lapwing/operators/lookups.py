"""Joins of functions, flows and summaries, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.prototypes import base_name, distinct_pairs, parse_params, pointer_kind


def with_similarity(functions: DataFrame, sim: DataFrame, how: str = "inner") -> DataFrame:
    return functions.join(sim, "funcname", how)


def target_callees(edges: DataFrame, belief: DataFrame, sim: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Callees whose data flow is followed: up to the first malloc of a caller, the
    believed ones and the similar ones that return a pointer."""
    first = edges.where("callee = 'malloc'").groupBy("caller", "pos").agg(F.min("nth").alias("_malloc"))
    b, s = belief.select(F.col("funcname").alias("callee"), "belief"), sim.select(F.col("funcname").alias("callee"), "cos")
    rows = edges.join(b, "callee", "left").join(s, "callee", "left")
    similar = (pointer_kind(F.col("return_type")) != "<noptr>") & (F.col("cos") >= threshold)
    rows = rows.where((F.col("callee") == "malloc") | (F.col("belief").isNotNull() & ((F.col("belief") == 1) | similar)))
    return rows.join(first, ["caller", "pos"], "left").where("_malloc IS NULL OR nth <= _malloc").drop("_malloc")


def last_by_name(functions: DataFrame, name: str = "funcname", order: str = "pos") -> DataFrame:
    """One row for each name: that of the largest position, listed at the smallest one."""
    rest = F.struct(*[c for c in functions.columns if c != name])
    return functions.groupBy(name).agg(F.max_by(rest, order).alias("r"), F.min(order).alias("first")).select(name, *[F.col(f"r.{c}") for c in functions.columns if c not in (name, order)], F.col("first").alias(order))


def first_by_name(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(rest, order).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rows.columns if c not in keys])


def believed_flows(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """Flows whose (caller, callee) is a target."""
    return flows.join(targets.select("caller", "callee").distinct(), ["caller", "callee"], "left_semi")


def summarised_edges(edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """Calls between two functions that both have a summary."""
    names = summaries.select("funcname").distinct()
    return edges.join(names.select(F.col("funcname").alias("caller")), "caller", "left_semi").join(names.select(F.col("funcname").alias("callee")), "callee", "left_semi")


def split_overlap(rows: DataFrame, other: DataFrame, key: str = "funcname") -> tuple[DataFrame, DataFrame]:
    """(rows the other has too, rows it has not)."""
    names = other.select(key)
    return rows.join(names, key, "left_semi"), rows.join(names, key, "left_anti")


def without_labelled(rows: DataFrame, *labelled: DataFrame) -> DataFrame:
    """Rows whose lower-cased name is in none of the label lists."""
    names = None
    for x in labelled:
        one = x.select(F.lower("funcname").alias("_name"))
        names = one if names is None else names.union(one)
    return rows.withColumn("_name", F.lower("funcname")).join(names, "_name", "left_anti").drop("_name")


def append_new(old: DataFrame, new: DataFrame, key: str = "funcname") -> DataFrame:
    """Old rows, and of the new ones those with a new name."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def symmetric_difference(old: DataFrame, new: DataFrame, key: str = "funcname") -> DataFrame:
    """(key, side): names that only one of the two has."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(True)), new.select(key).distinct().withColumn("_n", F.lit(True))
    return a.join(b, key, "full_outer").where("_o IS NULL OR _n IS NULL").select(key, F.when(F.col("_n").isNull(), "old").otherwise("new").alias("side"))


def next_units(compile_db: DataFrame, functions: DataFrame, depths: DataFrame, depth: int) -> DataFrame:
    """Compile commands of the files that hold functions of the next depth; all of them if there is none."""
    files = functions.join(depths.where(F.col("depth") == depth + 1).select("funcname"), "funcname", "left_semi").select("file").distinct()
    return compile_db if files.isEmpty() else compile_db.join(files, "file", "left_semi")


def found_prototypes(names: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prototypes of the names, names without one)."""
    rows = names.join(prototypes, "funcname", "left_outer").withColumn("_hit", F.col("return_type").isNotNull())
    return rows.where("_hit").drop("_hit"), rows.where("NOT _hit").select("funcname")


def single_parameter(summaries: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Summaries of functions with exactly one parameter."""
    return summaries.join(prototypes.where(F.size(parse_params(F.col("params"))) == 1).select("funcname"), "funcname", "left_semi")


def argument_index(rows: DataFrame, prototypes: DataFrame, name: str = "name") -> DataFrame:
    """Adds arg_index: where the name's base stands among the parameters; else 0 if there is one only, and 99 if not."""
    params = prototypes.select("funcname", F.transform(parse_params(F.col("params")), lambda p: p["name"]).alias("_names"))
    at = F.array_position("_names", base_name(F.col(name)))
    index = F.when(at > 0, at - 1).when(F.size("_names") == 1, 0).otherwise(99).cast("int")
    return rows.join(params, "funcname", "left").withColumn("arg_index", F.coalesce(index, F.lit(99))).drop("_names")


def merged_pairs(old: DataFrame, new: DataFrame, pairs: str = "pairs") -> DataFrame:
    """Full join of two summaries by name; pairs of both, the new ones first, distinct by name."""
    empty = F.array().cast("array<struct<idx:int,name:string>>")
    both = old.select("funcname", F.col(pairs).alias("_o")).join(new.select("funcname", F.col(pairs).alias("_n")), "funcname", "full_outer")
    return both.select("funcname", distinct_pairs(F.concat(F.coalesce("_n", empty), F.coalesce("_o", empty))).alias(pairs))


def call_summaries(calls: DataFrame, alloc: DataFrame, free: DataFrame, realloc: DataFrame) -> DataFrame:
    """Adds op: alloc before free before realloc, null for other calls."""
    names = alloc.select("funcname", F.lit(0).alias("p"), F.lit("alloc").alias("op")).union(free.select("funcname", F.lit(1), F.lit("free"))).union(realloc.select("funcname", F.lit(2), F.lit("realloc")))
    best = names.groupBy(F.col("funcname").alias("callee")).agg(F.min_by("op", "p").alias("op"))
    return calls.join(best, "callee", "left")


def prioritised(*tables: DataFrame, key: str = "funcname") -> DataFrame:
    """Union in which a name's row comes from the first table that has it."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_p", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    rest = F.struct(*[c for c in out.columns if c != key])
    return out.groupBy(key).agg(F.min_by(rest, "_p").alias("r")).select(key, *[F.col(f"r.{c}") for c in out.columns if c not in (key, "_p")])
