"""Vector functions: norm, cosine, centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda z, x: z + x)


def l2_normalise(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def cosine(v: Column, centroid: Column) -> Column:
    """Normalised v times the centroid, which is taken as it is."""
    return F.try_divide(dot(v, centroid), F.sqrt(dot(v, v)))


def centroids(df: DataFrame, key: str, vector: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the normalised vectors of distinct keys (the last by order wins), as an array, for each group.

    One partial sum for each group and dimension leaves a task.
    """
    by = by or []
    long = df.dropDuplicates([*by, key]).select(*by, F.posexplode(l2_normalise(F.col(vector))).alias("i", "x"))
    mean = long.groupBy(*by, "i").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid")
    return mean.groupBy(*by).agg(ordered) if by else mean.agg(ordered)


def scores(df: DataFrame, key: str, vector: str, centroid: DataFrame) -> DataFrame:
    """(key, cos), against a one-row table of the centroid."""
    return df.join(F.broadcast(centroid)).select(key, cosine(F.col(vector), F.col("centroid")).alias("cos"))


def squared_loss(cos: Column, label: Column) -> Column:
    """Squared distance of a pair's cosine to its label, 1 or -1."""
    return F.pow(cos - label, 2)


def contrastive_loss(cos: Column, label: Column, margin: float = 0.0) -> Column:
    """Pairs of a class are drawn to cosine 1, others pushed under the margin."""
    return F.when(label > 0, F.pow(1 - cos, 2)).otherwise(F.pow(F.greatest(cos - margin, F.lit(0.0)), 2))


def embedding_matrix(ids: DataFrame, pretrained: DataFrame, reserved: int, size: int) -> DataFrame:
    """(id, vector) of (word, id): reserved ids (1..reserved) are one-hot, other words take
    their pretrained vector (word, vector), and zeros where there is none."""
    rows = ids.join(pretrained, "word", "left")
    hot = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i == F.col("id")).cast("double"))
    zero = F.array_repeat(F.lit(0.0), size)
    return rows.select("id", F.when(F.col("id") <= reserved, hot).otherwise(F.coalesce("vector", zero)).alias("vector"))
