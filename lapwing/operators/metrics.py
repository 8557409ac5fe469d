"""Confusion counts, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rates() -> list[Column]:
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def threshold_metrics(scores: DataFrame, threshold: float = 0.5, inclusive: bool = False, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 of (cos, positive).

    Positive rows over the threshold are tp, else fn; negative rows under it are tn,
    else fp. So, unless inclusive, a row at the threshold counts against the model.
    """
    c, y = F.col("cos"), F.col("positive")
    hit, clear = (c >= threshold) if inclusive else (c > threshold), c < threshold
    counts = [F.count_if(y & hit).alias("tp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & clear).alias("tn"), F.count_if(~y & ~clear).alias("fp")]
    out = scores.groupBy(*by).agg(*counts) if by else scores.agg(*counts)
    return out.select(*(by or []), "tp", "fp", "fn", "tn", *_rates())


def label_metrics(found: DataFrame, labels: DataFrame, key: str = "funcname") -> DataFrame:
    """Confusion counts of a found set of names against (name, label)."""
    rows = labels.join(found.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    f, y = F.col("_f").isNotNull(), F.col("label") > 0
    return rows.agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(~y & ~f).alias("tn"), F.count_if(y & ~f).alias("fn")).select("tp", "fp", "tn", "fn", *_rates())


def class_metrics(found: DataFrame, labels: DataFrame, key: str = "funcname") -> DataFrame:
    """Each class and the pool (class null), a label met once: (class, tp, fp, fn, precision, recall, f1)."""
    pairs = found.select("class", key).distinct().withColumn("_f", F.lit(1)).join(labels.select("class", key).distinct().withColumn("_l", F.lit(1)), ["class", key], "full_outer")
    counts = [F.count_if(F.col("_f").isNotNull() & F.col("_l").isNotNull()).alias("tp"), F.count_if(F.col("_l").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn")]
    return pairs.rollup("class").agg(*counts).select("class", "tp", "fp", "fn", *_rates())
