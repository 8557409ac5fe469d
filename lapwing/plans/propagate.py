"""Fixpoints over the call graph: depth, belief and free summaries."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.staging import dropped, staged

#: Bound of the rounds of ``until_stable``.
ROUNDS = 15


def call_depths(edges: DataFrame, seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(funcname, depth): 1 + the largest depth of the callees that are seeds (depth 1) or
    candidates that reach one. A call of a function by itself adds nothing; a longer cycle
    among the functions that reach a seed has no largest depth and is an error.

    A function is settled once all its callees are, so the rounds are as many as the
    longest chain has calls. Each round joins only what was settled in the last one.
    """
    calls = edges.select("caller", "callee").where("caller <> callee").distinct().join(candidates.select(F.col("funcname").alias("caller")), "caller", "left_semi")
    calls = staged(calls.join(seeds.select(F.col("funcname").alias("caller")), "caller", "left_anti"), "calls")  # a seed stays at 1
    reached = reach(calls, seeds, sys.maxsize)
    calls = staged(calls.join(reached.select(F.col("funcname").alias("callee")), "callee", "left_semi"), "calls")
    counts = calls.groupBy(F.col("caller").alias("funcname")).agg(F.count("*").alias("open"))
    state = reached.join(counts, "funcname", "left").select("funcname", F.lit(1).alias("depth"), F.coalesce("open", F.lit(0)).alias("open"), F.col("open").isNull().alias("settled"))
    held = state = staged(state, "depth")
    while not state.where("settled").isEmpty():
        front = state.where("settled").select(F.col("funcname").alias("callee"), F.col("depth").alias("below"))
        up = calls.join(front, "callee").groupBy(F.col("caller").alias("funcname")).agg((F.max("below") + 1).alias("up"), F.count("*").alias("n"))
        left = F.col("open") - F.coalesce("n", F.lit(0))
        state = state.join(up, "funcname", "left").select("funcname", F.greatest("depth", "up").alias("depth"), left.alias("open"), ((F.col("open") > 0) & (left == 0)).alias("settled"))
        older, state = held, staged(state, "depth")
        dropped(older)
        held = state
    cyclic = [r["funcname"] for r in state.where("open > 0").orderBy("funcname").limit(5).collect()]
    if cyclic:
        raise ValueError(f"calls form a cycle, depth is not defined for: {cyclic}")
    return state.select("funcname", "depth")


def reach(edges: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """(funcname): all that calls something in ``start``, directly or not, and start itself.

    Semi-naive: a round extends the last round's new names, less those known.
    """
    calls = staged(edges.select("caller", "callee").distinct(), "calls")
    known = staged(start.select("funcname").distinct(), "known")
    front = known
    for _ in range(rounds):
        new = calls.join(front.select(F.col("funcname").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("funcname")).distinct().join(known, "funcname", "left_anti")
        front = staged(new, "front")
        if front.isEmpty():
            break
        older, known = known, staged(known.union(front), "known")
        dropped(older)
    return known


def beliefs(targets: DataFrame, seeds: DataFrame, abnormal: DataFrame, good: DataFrame, functions: DataFrame, rounds: int = 1000) -> DataFrame:
    """(funcname, belief) of the callers in ``targets`` (caller, callee) and the seeds.

    1: a seed, or a function whose flows are good, whose target callees are all decided,
    none of them abnormal and one of them believed. -1: a target callee is abnormal, no
    target is believed at the end (a cycle, or a callee that the graph lacks). The least
    fixpoint from the seeds doesn't depend on the order of visits; a function that meets
    itself in a cycle is believed if another target callee is.
    """
    calls = targets.select("caller", "callee").distinct().join(abnormal.select(F.col("funcname").alias("callee"), F.lit(True).alias("bad")), "callee", "left")
    spoiled = calls.groupBy("caller").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    able = staged(spoiled.where("NOT bad").join(good.select(F.col("funcname").alias("caller")), "caller", "left_semi").join(functions.select(F.col("funcname").alias("caller")), "caller", "left_semi").select("caller"), "able")
    open_calls = targets.select("caller", "callee").distinct().join(able, "caller", "left_semi")
    believed = reach(open_calls, seeds, rounds)
    rows = targets.select(F.col("caller").alias("funcname")).union(seeds.select("funcname")).distinct()
    return rows.join(believed.withColumn("_b", F.lit(1)), "funcname", "left").select("funcname", F.coalesce("_b", F.lit(-1)).alias("belief"))


def belief_bitmap(functions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(funcname, belief): 1 for seeds, else 0."""
    return functions.select("funcname").join(seeds.select("funcname", F.lit(1).alias("_s")).distinct(), "funcname", "left").select("funcname", F.coalesce("_s", F.lit(0)).alias("belief"))


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Repeat a step until the rows stay the same, at most ``rounds`` times."""
    state = staged(start, "state")
    before = _signature(state)
    for _ in range(rounds):
        older, state = state, staged(step(state), "state")
        dropped(older)
        after = _signature(state)
        if after == before:
            break
        before = after
    return state


def _signature(state: DataFrame) -> tuple:
    """Number of rows and sum of their hashes."""
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64(*state.columns).cast("decimal(38,0)"))).first())


def free_summaries(statements: DataFrame, prototypes: DataFrame, seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(funcname, params, members): what candidates free, found from the seeds up.

    A round reads the bodies of functions that call one whose summary changed in the last
    round (at first, a seed), with all summaries; it ends when none changes. A function
    that calls itself on a member (``f(n->next)``) finds a longer member each round, so
    rounds are bounded.
    """
    from lapwing.operators.dataflow import backward_aliases, consistent, freed_arguments

    own = staged(statements.join(candidates.select(F.col("funcname").alias("func")), "func", "left_semi"), "bodies")
    calls = staged(own.where("callee IS NOT NULL").select("func", "callee").distinct(), "body-calls")
    known = staged(statements.sparkSession.createDataFrame([], "funcname string, params array<struct<idx:int,name:string>>, members array<struct<idx:int,name:string>>"), "summaries")
    front = seeds.select(F.col("funcname").alias("callee")).distinct()
    for _ in range(rounds):
        touched = staged(calls.join(front, "callee", "left_semi").select("func").distinct(), "touched")
        bodies = own.join(touched, "func", "left_semi")
        found = consistent(backward_aliases(bodies, freed_arguments(bodies, seeds, known)), prototypes)
        new = staged(known.join(touched.withColumnRenamed("func", "funcname"), "funcname", "left_anti").unionByName(found), "summaries")
        marks = [t.select("funcname", F.xxhash64("params", "members").alias(h)) for t, h in ((known, "_old"), (new, "_new"))]
        front = staged(marks[0].join(marks[1], "funcname", "full_outer").where("NOT _old <=> _new").select(F.col("funcname").alias("callee")), "changed")
        dropped(known, touched)
        known = new
        if front.isEmpty():
            break
    return known
