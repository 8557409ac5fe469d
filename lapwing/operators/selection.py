"""Candidate selection by similarity and call-graph rules.

Tables: ``functions`` (funcname, return_type, params, file), ``edges`` (caller, callee,
return_type, params, number, nth), ``sim`` (funcname, cos). Lookups are equality joins
on names; Spark broadcasts the side whose size it knows to be small and shuffles
otherwise, so nothing here is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.prototypes import parse_params, pointer_kind

#: Fixed thresholds: candidate, strong belief.
CANDIDATE, STRONG = 0.5, 0.95
#: Semi-hard positives lie at or under, hardest negatives at or over, semi-hard negatives between.
SEMI_HARD_POSITIVE, HARDEST, SEMI_HARD_NEGATIVE = 0.5, 0.98, -0.8
#: Fixed words that exclude a function from the call-site count.
EXCLUDED = ("unregister", "remove", "cleanup", "unpin")


def _has_pointer(params):
    return F.exists(parse_params(params), lambda p: p["kind"] != "<noptr>")


def above(sim: DataFrame, threshold: float = CANDIDATE) -> DataFrame:
    return sim.where(F.col("cos") > threshold)


def alloc_candidates(functions: DataFrame, sim: DataFrame, threshold: float = CANDIDATE) -> DataFrame:
    """Similar functions that return a pointer or take one."""
    pointer = (pointer_kind(F.col("return_type")) != "<noptr>") | _has_pointer(F.col("params"))
    return functions.where(pointer).join(above(sim, threshold), "funcname")


def special_allocators(functions: DataFrame, edges: DataFrame, sim: DataFrame, strong: float = STRONG, threshold: float = CANDIDATE) -> DataFrame:
    """Very similar functions that return ``type *`` and call allocators: once exactly if it is a struct."""
    alike = sim.where(F.col("cos") >= threshold).select(F.col("funcname").alias("callee"))
    calls = edges.join(alike, "callee", "left_semi").groupBy(F.col("caller").alias("funcname")).agg(F.sum("number").alias("n_alloc_calls"))
    rows = functions.where(pointer_kind(F.col("return_type")) == "<ptr>").join(above(sim, strong), "funcname").join(calls, "funcname")
    return rows.where((F.col("n_alloc_calls") >= 1) & (~F.col("return_type").contains("struct") | (F.col("n_alloc_calls") == 1)))


def free_candidates(functions: DataFrame, edges: DataFrame, sim: DataFrame, denied: DataFrame | None = None, threshold: float = CANDIDATE) -> tuple[DataFrame, DataFrame]:
    """(candidates, their calls to similar functions): no pointer returned, one taken, a similar one called."""
    near = above(sim, threshold)
    rows = functions.where((pointer_kind(F.col("return_type")) == "<noptr>") & _has_pointer(F.col("params"))).join(near, "funcname")
    if denied is not None:
        rows = rows.join(denied.select("funcname"), "funcname", "left_anti")
    calls = edges.join(near.select(F.col("funcname").alias("callee")), "callee", "left_semi")
    found = rows.join(calls.groupBy(F.col("caller").alias("funcname")).agg(F.sum("number").alias("n_free_calls")).where("n_free_calls >= 1"), "funcname")
    return found, calls.join(found.select(F.col("funcname").alias("caller")), "caller", "left_semi")


def special_deallocators(functions: DataFrame, edges: DataFrame, sim: DataFrame, reassigned: DataFrame, call_counts: DataFrame, least: int = 10, strong: float = STRONG, threshold: float = CANDIDATE) -> DataFrame:
    """void functions, very similar, whose argument is set to null often after the call.

    ``reassigned`` has (funcname, arg_index, n), ``call_counts`` (funcname, n_calls). One
    similar callee exactly; the argument is no struct; out if 2 n >= calls while n is
    within ten of the least.
    """
    near = sim.where(F.col("cos") > threshold).select(F.col("funcname").alias("callee"))
    calls = edges.join(near, "callee", "left_semi").groupBy(F.col("caller").alias("funcname")).agg(F.sum("number").alias("n_free_calls")).where("n_free_calls = 1")
    rows = functions.where(F.col("return_type").contains("void")).join(above(sim, strong), "funcname").join(reassigned.where(F.col("n") >= least), "funcname").join(calls, "funcname").join(call_counts, "funcname")
    kind = F.get(parse_params(F.col("params")), F.col("arg_index"))["raw_type"]
    weak = (2 * F.col("n") >= F.col("n_calls")) & (F.col("n") < least + 10)
    return rows.where(kind.isNotNull() & ~kind.contains("struct") & ~weak).select("funcname", "arg_index", "n", "n_calls")


def chain_candidates(candidates: DataFrame, targets: DataFrame, belief: DataFrame) -> DataFrame:
    """Candidates with a target callee that are not believed yet."""
    believed = belief.where("belief = 1").select("funcname")
    return candidates.join(targets.select(F.col("caller").alias("funcname")), "funcname", "left_semi").join(believed, "funcname", "left_anti")


def by_extension(functions: DataFrame, *extensions: str) -> DataFrame:
    """Rows whose file ends with one of the extensions."""
    keep = F.lit(False)
    for e in extensions or (".c",):
        keep = keep | F.col("file").endswith(e)
    return functions.where(keep)


def excluded_name(name):
    return name.rlike("|".join(EXCLUDED))


def hard_flags(cos, positive):
    """(semi_hard_positive, hardest, semi_hard_negative) of a pair's cosine."""
    return F.struct(
        (positive & (cos <= SEMI_HARD_POSITIVE)).alias("semi_hard_positive"),
        (~positive & (cos >= HARDEST)).alias("hardest"),
        (~positive & cos.between(SEMI_HARD_NEGATIVE, HARDEST)).alias("semi_hard_negative"),
    )


def split_by_flags(df: DataFrame, *flags: str) -> list[DataFrame]:
    """A frame for each flag; a row may be in several."""
    return [df.where(F.col(f)) for f in flags]


def call_counts(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(funcname, n_calls): 1 + calls of each candidate whose name isn't excluded."""
    names = candidates.select("funcname").distinct().where(~excluded_name(F.col("funcname")))
    calls = edges.groupBy(F.col("callee").alias("funcname")).agg(F.sum("number").alias("n"))
    return names.join(calls, "funcname", "left").select("funcname", (F.lit(1) + F.coalesce("n", F.lit(0))).alias("n_calls"))
