"""The stages of a whole analysis, as functions from tables to tables.

Extraction of prototypes, statements and traces from C, and the encoder's training,
are external: the inputs are the call graph, statement facts, traces, and a model
that turns token sequences into vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.functions.prototypes import LONGEST_NAME, normalised_tokens, parse_params, parse_prototype
from lapwing.functions.segment import k_best_udf, segment_udf
from lapwing.functions.vectors import centroids, scores
from lapwing.operators import dataflow, lookups, selection, sets, summaries
from lapwing.plans import propagate

#: Named models: a function from a batch of token lists to vectors.
MODELS: dict[str, Callable[[list[list[str]]], list[list[float]]]] = {}
BATCH = 3000


def register_model(name: str, model: Callable[[list[list[str]]], list[list[float]]]) -> None:
    MODELS[name] = model


def list_models() -> list[str]:
    return sorted(MODELS)


def hashed_vectors(batch: list[list[str]], size: int = 128) -> list[list[float]]:
    """A model without training: signed counts of hashed tokens, of length one."""
    out = []
    for tokens in batch:
        v = [0.0] * size
        for t in tokens:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


register_model("hashed", hashed_vectors)


def embed(df: DataFrame, tokens: str = "tokens", model: str = "hashed") -> DataFrame:
    """Adds ``vector``, in Arrow batches of at most ``BATCH`` rows."""
    run_model = MODELS[model]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [list(t) for t in part]
            made: list[list[float]] = []
            for k in range(0, len(rows), BATCH):
                made += run_model(rows[k : k + BATCH])
            yield pd.Series(made)

    return df.withColumn("vector", run(tokens))


def tokens_of(prototypes: DataFrame, counts: dict[str, float], total: float | None = None) -> DataFrame:
    """(funcname, tokens) of distinct prototypes; names over the bound are left out, by
    name and not by place. Prototypes of one name with other types or arguments have a
    row each."""
    cut = segment_udf(counts, total)
    rows = prototypes.select("funcname", "return_type", "params").distinct().where(F.length("funcname") <= LONGEST_NAME).withColumn("p", parse_params(F.col("params")))
    # all names of a prototype travel in one string: the segmenter sees each distinct one once
    names = rows.select(F.explode(F.concat(F.array("funcname"), F.transform("p", lambda x: x["name"]))).alias("name")).distinct().withColumn("words", cut("name"))
    long = rows.select("funcname", "return_type", "params", F.posexplode(F.concat(F.array(F.struct(F.lit("").alias("kind"), F.col("funcname").alias("name"))), F.transform("p", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"))))).alias("i", "a"))
    found = long.join(names, F.col("a.name") == F.col("name")).groupBy("funcname", "return_type", "params").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a.kind", "words"))), lambda x: F.struct(x["kind"].alias("kind"), x["words"].alias("words"))).alias("w"))
    return found.select("funcname", normalised_tokens(F.col("return_type"), F.get("w", F.lit(0))["words"], F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))).alias("tokens"))


def token_variants(prototypes: DataFrame, counts: dict[str, float], k: int, total: float | None = None) -> DataFrame:
    """(funcname, variant, tokens): k segmentations of the function's name, each with the
    best ones of its parameters' names."""
    best = tokens_of(prototypes, counts, total)
    heads = prototypes.where(F.length("funcname") <= LONGEST_NAME).select("funcname", F.posexplode(k_best_udf(counts, k, total)("funcname")).alias("variant", "words"))
    # the name's words stand between the kind and the first parenthesis
    tail = F.slice("tokens", F.array_position("tokens", "(").cast("int"), F.size("tokens"))
    return heads.join(best, "funcname").select("funcname", "variant", F.concat(F.slice("tokens", 1, 2), "words", tail).alias("tokens"))


def training_batches(pairs: DataFrame, size: int = 100) -> Iterator[list]:
    """Batches of rows for a trainer, one partition at a time on the driver."""
    batch: list = []
    for row in pairs.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def raw_prototypes(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(parse_prototype(F.col(column)).alias("r")).where("r IS NOT NULL").select("r.*")


def similarity_inference(prototypes: DataFrame, counts: dict[str, float], reference: DataFrame, model: str = "hashed") -> DataFrame:
    """(funcname, cos): prototypes against the centroid of the reference prototypes."""
    centre = centroids(embed(tokens_of(reference, counts), model=model), "funcname", "vector")
    return scores(embed(tokens_of(prototypes, counts), model=model), "funcname", "vector", centre)


def allocation_stage(functions: DataFrame, edges: DataFrame, sim: DataFrame, official: DataFrame, flows: DataFrame) -> DataFrame:
    """Summaries of allocators: candidates, seeds, believed flows, what escapes."""
    candidates = selection.alloc_candidates(functions, sim)
    seeds = sets.seed_allocators(official, selection.special_allocators(functions, edges, sim))
    bitmap = propagate.belief_bitmap(functions.select("funcname").union(official.select("funcname")).distinct(), seeds)
    targets = lookups.target_callees(edges, bitmap, sim).join(candidates.select(F.col("funcname").alias("caller")), "caller", "left_semi")
    used = lookups.believed_flows(summaries.distinct_flows(flows), targets)
    good, escapes = dataflow.belief_flows(used.withColumn("pos", F.xxhash64("caller", "callee")), functions)
    abnormal = escapes.select("funcname")
    belief = propagate.beliefs(targets, seeds, abnormal, good, functions)
    return dataflow.alloc_summaries(belief.where("belief = 1").select("funcname"), escapes)


def free_stage(functions: DataFrame, edges: DataFrame, sim: DataFrame, official: DataFrame, statements: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(normal, customised) deallocators: candidates, call sites, null checks, seeds, the fixpoint."""
    candidates, _ = selection.free_candidates(functions, edges, sim)
    counts = selection.call_counts(candidates, edges)
    checks = summaries.null_checks(dataflow.null_resets(statements, candidates))
    special = selection.special_deallocators(functions, edges, sim, checks, counts, least)
    seeds = sets.seed_deallocators(official, special)
    found = propagate.free_summaries(statements, functions, seeds, candidates)
    normal = summaries.is_normal_free(F.col("params"), F.col("members"))
    return sets.add_primitives(found.where(normal), found.where(~normal), seeds)
