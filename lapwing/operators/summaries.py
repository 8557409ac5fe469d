"""Aggregations over calls, flows and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.prototypes import distinct_pairs, parse_params

#: Argument indices that the null-check histogram counts.
BINS = 7


def calls_by_name(edges: DataFrame) -> DataFrame:
    """(pos, caller, callee, number): how often each callee is called in a caller group.

    A callee's first line gives its number (1 if it has none), each repeat adds one, so
    a graph that was compacted before keeps its counts. ``edges`` (pos, caller, nth, callee,
    number); equal nth are taken by number.
    """
    first = F.min_by(F.coalesce("number", F.lit(1)), F.struct("nth", "number")).cast("long")
    return edges.groupBy("pos", "caller", "callee").agg((first + F.count("*") - 1).alias("number"))


def best_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(caller, pos, n_callees): of a caller's groups, the one with most distinct callees, of equal ones the first.

    ``groups`` (caller, pos) also lists groups without calls. One row for each group is
    ranked, not the calls themselves.
    """
    return _best(edges.groupBy("caller", "pos").agg(F.countDistinct("callee").alias("n")), groups)


def _best(n: DataFrame, groups: DataFrame) -> DataFrame:
    rows = groups.join(n, ["caller", "pos"], "left").select("caller", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("caller").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"), F.max("n").alias("n_callees"))


def compacted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The call graph of the best groups: (caller, callee, number)."""
    counted = calls_by_name(edges)  # a group's callees are its rows: both sides read the same exchange
    best = _best(counted.groupBy("caller", "pos").agg(F.count("*").alias("n")), groups).select("caller", "pos")
    return counted.join(best, ["caller", "pos"], "left_semi").select("caller", "callee", "number")


def null_checks(events: DataFrame) -> DataFrame:
    """(funcname, arg_index, n): the argument set to null most often, of equal ones the lowest.

    Indices from ``BINS`` on don't count; a function with such only is listed with 0, 0.
    """
    bins = events.groupBy("funcname", "arg_index").agg(F.count("*").alias("c"))
    inside = F.when(F.col("arg_index") < BINS, F.col("c")).otherwise(0)
    rows = bins.select("funcname", F.when(F.col("arg_index") < BINS, F.col("arg_index")).otherwise(0).alias("i"), inside.alias("c"))
    return rows.groupBy("funcname").agg(F.max_by("i", F.struct("c", -F.col("i"))).alias("arg_index"), F.max("c").alias("n"))


def first_then_number(edges: DataFrame, order: list[str], key: str = "callee") -> DataFrame:
    """(callee, n): a callee's first call adds one, each later call its number."""
    first = F.min_by("number", F.struct(*order))
    return edges.groupBy(key).agg((F.sum("number") - first + 1).alias("n"))  # a hot callee is summed in each task first


def void_pointer_callees(edges: DataFrame) -> DataFrame:
    """Calls of functions that return void and take pointers only (one at least)."""
    p = parse_params(F.col("params"))
    return edges.where(F.col("return_type").contains("void") & (F.size(p) > 0) & F.forall(p, lambda x: x["kind"] == "<ptr>"))


def drop_callers_of(counts: DataFrame, edges: DataFrame, low: int = 30, high: int = 50) -> DataFrame:
    """Functions that aren't called ``low`` times while calling one that is called ``high`` times."""
    often = counts.where(F.col("n") >= high).select(F.col("funcname").alias("callee"))
    calling = edges.join(often, "callee", "left_semi").select(F.col("caller").alias("funcname")).distinct()
    bad = counts.where(F.col("n") >= low).select("funcname").join(calling, "funcname", "left_semi")
    return counts.join(bad, "funcname", "left_anti")


def belief_cut(top: DataFrame, counts: DataFrame, least: int) -> int:
    """least over the smallest share of null assignments among the first ten functions."""
    first = top.orderBy(F.desc("n"), "funcname").limit(10)
    row = first.join(counts, "funcname").agg(F.min(F.col("n") / F.col("n_calls")).alias("r")).first()
    return int(least / row["r"]) if row and row["r"] else 0


def primitive_deallocators(counts: DataFrame, edges: DataFrame, sim: DataFrame, min_call: int = 50, threshold: float = 0.5) -> DataFrame:
    """Of (funcname, n_calls), the functions that call no similar function called more than ``min_call`` times."""
    often = counts.where(F.col("n_calls") > min_call).join(sim.where(F.col("cos") >= threshold), "funcname", "left_semi").select(F.col("funcname").alias("callee"))
    wrapping = edges.join(often, "callee", "left_semi").select(F.col("caller").alias("funcname")).distinct()
    return counts.join(wrapping, "funcname", "left_anti")


def primitive_seeds(counts: DataFrame, checks: DataFrame, edges: DataFrame, sim: DataFrame, min_call: int = 50, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(functions left with their calls, seeds with their argument): functions that only wrap
    a frequent one are left out, then those called often but seldom set to null.

    ``checks`` (funcname, arg_index, n). How often is often follows from the ten functions
    set to null most.
    """
    cut = belief_cut(checks, counts, least)
    primitive = primitive_deallocators(counts, edges, sim, min_call)
    yes, no = split_truth(primitive, checks, cut, least)
    return primitive.join(no, "funcname", "left_anti"), yes


def split_truth(counts: DataFrame, checks: DataFrame, cut: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Of functions called more than ``cut`` times: (those with ``least`` null assignments and their argument, the others)."""
    rows = counts.where(F.col("n_calls") > cut).join(checks, "funcname", "left").withColumn("_ok", F.coalesce(F.col("n") >= least, F.lit(False)))
    return rows.where("_ok").select("funcname", "arg_index"), rows.where("NOT _ok").select("funcname")


def merged_flows(flows: DataFrame) -> DataFrame:
    """(funcname, params, members): a function's flows joined, the newest first, pairs distinct by name."""
    def newest(c: str):
        return distinct_pairs(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", c)), False), lambda r: r[c])))

    return flows.groupBy("funcname").agg(newest("params").alias("params"), newest("members").alias("members"))


def distinct_flows(flows: DataFrame) -> DataFrame:
    """Flows that carry something, one for each (caller, callee): the first."""
    carries = (F.size("passed_params") > 1) | (F.size("return_values") > 1) | (F.col("direct_return") != 0)
    rest = [c for c in flows.columns if c not in ("caller", "callee")]
    return flows.where(carries).groupBy("caller", "callee").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("caller", "callee", *[F.col(f"r.{c}") for c in rest])


def alloc_classes(summaries: DataFrame) -> DataFrame:
    """Counts of summaries that return only, fill parameters only, or both."""
    r, p = F.size("returned_object") > 0, F.size("param_object") > 0
    return summaries.groupBy(F.when(r & p, "both").when(r, "return").when(p, "param").otherwise("none").alias("bucket")).agg(F.count("*").alias("n"))


def free_classes(summaries: DataFrame) -> DataFrame:
    """Counts of summaries: normal (exactly one parameter, the first, no members), param, member, both."""
    p, m = F.size("params") > 0, F.size("members") > 0
    normal = (F.size("params") == 1) & ~m & (F.get("params", F.lit(0))["idx"] == 0)
    return summaries.groupBy(F.when(normal, "normal").when(p & m, "both").when(p, "param").when(m, "member").otherwise("none").alias("bucket")).agg(F.count("*").alias("n"))


def is_normal_free(params, members):
    return (F.size(params) == 1) & (F.size(members) == 0) & (F.get(params, F.lit(0))["idx"] == 0)


def starred_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.agg(F.count_if(F.col(column).contains("*")).alias("n"))


def usable_directly(summaries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(funcname, idx, name): summaries of one parameter without members, and the seeds."""
    one = summaries.where((F.size("members") == 0) & (F.size("params") == 1)).select("funcname", F.get("params", F.lit(0))["idx"].alias("idx"), F.get("params", F.lit(0))["name"].alias("name"))
    return one.unionByName(seeds.select("funcname", F.col("arg_index").alias("idx"), F.lit("").alias("name")))
