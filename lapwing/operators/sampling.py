"""Seeded sampling for training sets. Order keys are hashes of the rows, so a sample
doesn't depend on how the rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.ordering import renumbered
from lapwing.staging import staged


def _draw(seed: int, *columns: str):
    return F.xxhash64(F.lit(seed), *columns)


def k_per_anchor(pairs: DataFrame, k: int, seed: int = 1, anchor: str = "anchor", other: str = "other", limit: str | None = None) -> DataFrame:
    """At most k partners of each anchor, without replacement (or as many as the column ``limit`` says)."""
    w = Window.partitionBy(anchor).orderBy(_draw(seed, anchor, other), other)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= (F.col(limit) if limit else F.lit(k))).drop("_r")


def labelled_pairs(anchors: DataFrame, positives: DataFrame, negatives: DataFrame, k: int = 40, seed: int = 1) -> DataFrame:
    """(anchor, other, y): for each anchor k positives (y 1) and k negatives (y -1).

    Partners are drawn by position: k places of the class table, each drawn by a hash of
    its own, without replacement. The class tables are numbered once and joined by number;
    no anchor meets all partners. Fewer than k partners: all of them.
    """
    def drawn(table: DataFrame, y: int) -> DataFrame:
        numbered = table.select(F.col("name").alias("other")).distinct()
        numbered = staged(renumbered(numbered.withColumn("h", _draw(seed, "other")), "h", "other", name="n").select("other", (F.col("n") - 1).alias("n")), "partners")
        total = numbered.count()
        if not total:
            return anchors.select(F.col("name").alias("anchor"), F.lit(None).cast("string").alias("other"), F.lit(y).alias("y")).limit(0)
        h = f"xxhash64({seed + y}, name, d)"
        if total <= 4 * k:  # all places, in the order of their hashes
            places = f"transform(array_sort(transform(sequence(0L, {total - 1}L), d -> struct({h} AS h, d))), s -> s.d)"
        else:  # four times as many draws as are asked for; the first places follow should they collide
            places = f"array_distinct(concat(transform(sequence(1L, {4 * k}L), d -> pmod({h}, {total}L)), sequence(0L, {k - 1}L)))"
        draws = anchors.select(F.col("name").alias("anchor"), F.explode(F.expr(f"slice({places}, 1, {k})")).alias("n"))
        return draws.join(numbered, "n").select("anchor", "other", F.lit(y).alias("y"))

    return drawn(positives, 1).union(drawn(negatives, -1))


def resampled_pairs(pairs: DataFrame, hard: DataFrame, k: int = 40, seed: int = 2) -> DataFrame:
    """Twice as many partners for semi-hard anchors, and up to k of the semi-hard negatives.

    ``pairs`` (anchor, other, y, semi_hard), ``hard`` (anchor, other): semi-hard negatives.
    """
    more = pairs.withColumn("_k", F.when(F.col("semi_hard"), 2 * k).otherwise(k))
    kept = [k_per_anchor(more.where(F.col("y") == y), k, seed, limit="_k").drop("_k", "semi_hard") for y in (1, -1)]
    extra = k_per_anchor(hard, k, seed + 1).select("anchor", "other", F.lit(-1).alias("y"))
    return kept[0].unionByName(kept[1]).unionByName(extra)


def stratified_holdout(df: DataFrame, stratum: str, share: float, key: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training, held out): of each stratum of n rows exactly floor(share * n) are held out."""
    return _split_strata(df, stratum, F.floor(F.col("_n") * share), key, seed)


def equal_holdout(df: DataFrame, stratum: str, n: int, key: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training, held out): n rows of each stratum are held out."""
    return _split_strata(df, stratum, F.lit(n), key, seed)


def _split_strata(df: DataFrame, stratum: str, held: Column, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The first ``held`` rows of each stratum in the order of their hashes are held out.

    Rows are numbered over range partitions of (stratum, hash), so that a stratum of any
    size is dealt over many tasks; a stratum's first number makes ranks of the numbers.
    """
    rows = staged(renumbered(df.withColumn("_h", _draw(seed, key)), stratum, "_h", key, name="_i"), "strata").drop("_h")
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    ranked = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_held", F.col("_i") - F.col("_first") < held)
    return tuple(ranked.where(c).select(*df.columns) for c in ("NOT _held", "_held"))


def triplets(anchors: DataFrame, positives: DataFrame, negatives: DataFrame, per_anchor: int = 1, seed: int = 1) -> DataFrame:
    """(anchor, positive, negative), as many for each anchor."""
    p = labelled_pairs(anchors, positives, negatives, per_anchor, seed)
    n = F.row_number().over(Window.partitionBy("anchor", "y").orderBy(_draw(seed, "other"), "other"))
    rows = p.withColumn("n", n)
    return rows.where("y = 1").select("anchor", "n", F.col("other").alias("positive")).join(rows.where("y = -1").select("anchor", "n", F.col("other").alias("negative")), ["anchor", "n"]).drop("n")


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    return df.orderBy(_draw(seed, key), key)


def random_callers(functions: DataFrame, n: int = 3000, seed: int = 1) -> DataFrame:
    """n callers whose file ends with .c or .h, in a seeded order."""
    return shuffled(functions.where(F.col("file").rlike(r"\.[ch]$")), "funcname", seed).limit(n)


def merged_classes(alloc: DataFrame, free: DataFrame, neg: DataFrame) -> DataFrame:
    """(target, name, positive): the negatives of a class are the other class and the rest."""
    def one(t: str, pos: DataFrame, other: DataFrame) -> DataFrame:
        return pos.select(F.lit(t).alias("target"), "name", F.lit(True).alias("positive")).union(other.union(neg).select(F.lit(t), "name", F.lit(False)))

    alloc, free, neg = alloc.select("name"), free.select("name"), neg.select("name")
    return one("alloc", alloc, free).union(one("free", free, alloc))
