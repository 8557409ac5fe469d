"""Data flow inside functions, as ordered folds over statement facts.

``statements``: func, seq, kind (call, assign, decl, return), lhs, rhs, callee and
args (idx, is_ptr, name). A function's statements are one array, in order; a fold in
SQL walks it, so each function is one row of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.prototypes import base_name, member_name, parse_params

_NAMES = "CAST(array() AS array<string>)"
_BASE = "regexp_extract({x}, '^&?([^-.\\\\[]*)', 1)"


def _bodies(statements: DataFrame, ascending: bool = True) -> DataFrame:
    fields = F.struct("seq", "kind", "lhs", "rhs", "callee", "args")
    return statements.groupBy("func").agg(F.sort_array(F.collect_list(fields), ascending).alias("body"))


def forward_taint(statements: DataFrame, targets: DataFrame) -> DataFrame:
    """(caller, callee, passed_params, return_values, direct_return) for each target callee (caller, callee).

    In source order: what receives the callee's result is tainted, and so is what is
    assigned from something tainted; all returned names are listed, and a direct return
    of the call is flagged.
    """
    base = _BASE.format(x="s.rhs")
    left = _BASE.format(x="s.lhs")
    step = f"""struct(
        CASE WHEN s.kind IN ('assign', 'decl') AND s.lhs IS NOT NULL AND (s.callee <=> target OR (s.callee IS NULL AND array_contains(z.t, {base}) AND {left} <> s.rhs))
             THEN array_union(z.t, array(s.lhs)) ELSE z.t END AS t,
        CASE WHEN s.kind = 'return' AND s.rhs IS NOT NULL AND s.callee IS NULL THEN concat(z.r, array(s.rhs)) ELSE z.r END AS r,
        CASE WHEN s.kind = 'return' AND s.callee <=> target THEN 1 ELSE z.d END AS d)"""
    fold = f"aggregate(body, struct({_NAMES} AS t, {_NAMES} AS r, 0 AS d), (z, s) -> {step})"
    wanted = targets.select(F.col("caller").alias("func"), F.col("callee").alias("target")).distinct()
    rows = _bodies(statements.join(wanted, "func", "left_semi")).join(wanted, "func")  # bodies of callers only
    return rows.select(F.col("func").alias("caller"), F.col("target").alias("callee"), F.expr(fold).alias("f")).select("caller", "callee", F.col("f.t").alias("passed_params"), F.col("f.r").alias("return_values"), F.col("f.d").alias("direct_return"))


def freed_arguments(statements: DataFrame, seeds: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Calls with the expressions they free: (func, seq, freed).

    A seed (funcname, arg_index) frees that argument; a summary (funcname, params,
    members of (idx, name)) frees its parameters and, with the base replaced by the
    argument, its members.
    """
    calls = statements.where("callee IS NOT NULL").select("func", "seq", "callee", "args")
    at = lambda idx: f"get(filter(args, a -> a.idx = {idx}), 0).name"
    out = calls.join(seeds.select(F.col("funcname").alias("callee"), "arg_index"), "callee").select("func", "seq", F.expr(f"array({at('arg_index')})").alias("freed"))
    if summaries is not None:
        rows = calls.join(summaries.select(F.col("funcname").alias("callee"), "params", "members"), "callee")
        member = "concat(get(filter(args, a -> a.idx = m.idx), 0).name, regexp_extract(m.name, '^[^-.\\\\[]*(.*)$', 1))"
        params = "transform(params, m -> get(filter(args, a -> a.idx = m.idx), 0).name)"
        out = out.union(rows.select("func", "seq", F.expr(f"concat({params}, transform(members, m -> {member}))").alias("freed")))
    return out.groupBy("func", "seq").agg(F.flatten(F.collect_list("freed")).alias("freed"))


def backward_aliases(statements: DataFrame, freed: DataFrame) -> DataFrame:
    """(func, names): freed expressions and, last statement first, what they are aliases of."""
    rows = statements.join(freed, ["func", "seq"], "left")
    body = rows.groupBy("func").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "lhs", "rhs", "freed")), False).alias("body"))
    base_of = "regexp_extract(n, '^&?([^-.\\\\[]*)', 1)"
    moved = f"transform(filter(z, n -> n = s.lhs OR {base_of} = s.lhs), n -> concat(s.rhs, regexp_extract(n, '^[^-.\\\\[]*(.*)$', 1)))"
    step = f"CASE WHEN s.kind IN ('assign', 'decl') AND s.rhs IS NOT NULL AND s.lhs IS NOT NULL THEN array_union(array_union(z, coalesce(s.freed, {_NAMES})), {moved}) ELSE array_union(z, coalesce(s.freed, {_NAMES})) END"
    names = body.select("func", F.expr(f"filter(aggregate(body, {_NAMES}, (z, s) -> {step}), n -> n IS NOT NULL)").alias("names"))
    return names.where("size(names) > 0")


def consistent(names: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(funcname, params, members) of freed names that belong to parameters; others are left out."""
    params = prototypes.select(F.col("funcname").alias("func"), F.transform(parse_params(F.col("params")), lambda p: p["name"]).alias("p"))
    rows = names.join(params, "func").select("func", "p", F.explode("names").alias("n")).withColumn("idx", F.array_position("p", base_name(F.col("n"))).cast("int") - 1).where("idx >= 0")
    member = F.col("n").rlike("[-.]")
    pair = F.struct("idx", F.col("n").alias("name"))
    out = rows.groupBy(F.col("func").alias("funcname")).agg(F.array_sort(F.collect_set(F.when(~member, pair))).alias("params"), F.array_sort(F.collect_set(F.when(member, pair))).alias("members"))
    return out.where("size(params) + size(members) > 0")


def null_resets(statements: DataFrame, candidates: DataFrame) -> DataFrame:
    """(funcname, arg_index) for each later assignment to a pointer that was passed to a candidate.

    A variable belongs to the first candidate call that takes it; each later
    assignment to it counts.
    """
    calls = statements.where("callee IS NOT NULL").join(candidates.select(F.col("funcname").alias("callee")), "callee", "left_semi")
    args = calls.select("func", "seq", "callee", F.explode("args").alias("a")).where("a.is_ptr").select("func", "seq", "callee", F.col("a.idx").alias("arg_index"), F.col("a.name").alias("var"))
    first = args.groupBy("func", "var").agg(F.min_by(F.struct("callee", "arg_index"), F.struct("seq", "arg_index")).alias("f"), F.min("seq").alias("at"))
    sets = statements.where("kind = 'assign'").select("func", F.col("lhs").alias("var"), F.col("seq").alias("later"))
    return sets.join(first, ["func", "var"]).where("later > at").select(F.col("f.callee").alias("funcname"), F.col("f.arg_index").alias("arg_index"))


def belief_flows(flows: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(callers whose flows make them allocators, what escapes to their parameters).

    A direct return is enough; else a passed variable must be returned and nothing may
    escape. A passed member of a parameter escapes, unless the first flow returns an
    argument itself. Flows: (pos, caller, callee, passed_params, return_values, direct_return).
    """
    names = prototypes.select(F.col("funcname").alias("caller"), F.transform(parse_params(F.col("params")), lambda p: p["name"]).alias("args"))
    real = lambda c: F.filter(F.col(c), lambda x: x != "<nops>")
    rows = flows.join(names, "caller", "left").withColumn("passed", real("passed_params")).withColumn("returned", real("return_values"))
    first = rows.groupBy("caller").agg(F.min_by(F.coalesce(F.arrays_overlap("returned", "args"), F.lit(False)), "pos").alias("returns_arg"))
    rows = rows.join(first, "caller")
    escapes = rows.where("NOT returns_arg").select("caller", "args", F.explode("passed").alias("n")).withColumn("idx", F.array_position("args", base_name(F.col("n"))).cast("int") - 1).where("idx >= 0")
    escapes = escapes.select("caller", F.struct("idx", member_name(F.col("n")).alias("name")).alias("pair"))
    facts = rows.groupBy("caller").agg(F.max(F.col("direct_return") != 0).alias("direct"), F.max(F.coalesce(F.arrays_overlap("passed", "returned"), F.lit(False))).alias("kept"))
    leaking = escapes.select("caller").distinct().withColumn("_e", F.lit(True))
    good = facts.join(leaking, "caller", "left").where("direct OR (kept AND _e IS NULL)").select(F.col("caller").alias("funcname"))
    return good, escapes.groupBy(F.col("caller").alias("funcname")).agg(F.array_sort(F.collect_set("pair")).alias("param_object"))


def alloc_summaries(believed: DataFrame, escapes: DataFrame) -> DataFrame:
    """(funcname, returned_object, param_object): believed functions return what they allocate, others fill parameters."""
    empty = F.array().cast("array<struct<idx:int,name:string>>")
    normal = believed.select("funcname", F.array(F.lit("ret")).alias("returned_object"), empty.alias("param_object"))
    others = escapes.join(believed, "funcname", "left_anti").select("funcname", F.array().cast("array<string>").alias("returned_object"), "param_object")
    return normal.unionByName(others)


def first_target_call(statements: DataFrame, targets: DataFrame) -> DataFrame:
    """The first call in each function of one of the targets."""
    w = Window.partitionBy("func").orderBy("seq")
    return statements.join(targets.select(F.col("funcname").alias("callee")), "callee", "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
