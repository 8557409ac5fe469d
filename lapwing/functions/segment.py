"""Unigram segmentation of names into words.

Best: the cut with the largest sum of log10 frequencies, of equal sums the list of
words that is greatest in order. Words are at most ``LIMIT`` letters. The vocabulary
is a parameter: a mapping of words to counts and a total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, CHUNK, CARRY = 12, 250, 5
#: Log-frequency of a word that the vocabulary lacks.
UNKNOWN = -99999999999999999


class Segmenter:
    def __init__(self, counts: dict[str, float], total: float | None = None):
        total = total or sum(counts.values())
        self.logs = {w: math.log10(c / total) for w, c in counts.items() if c}

    def _tails(self, text: str) -> list[tuple[float, list[str]]]:
        """The best (score, words) of each tail of the text."""
        n, logs = len(text), self.logs
        best: list[tuple[float, list[str]]] = [(0.0, [])] * (n + 1)
        for i in range(n - 1, -1, -1):
            top = None
            for j in range(i + 1, min(n, i + LIMIT) + 1):
                score = logs.get(text[i:j], UNKNOWN) + best[j][0]
                if top is None or score >= top[0]:
                    found = (score, [text[i:j], *best[j][1]])
                    if top is None or found > top:
                        top = found
            best[i] = top
        return best

    def best(self, name: str) -> list[str]:
        """Long names are cut in chunks; the last words of one are tried again with the next."""
        text = "".join(c for c in name.lower() if "a" <= c <= "z")
        words, carry = [], ""
        for at in range(0, len(text), CHUNK):
            found = self._tails(carry + text[at : at + CHUNK])[0][1]
            words += found[:-CARRY]
            carry = "".join(found[-CARRY:])
        return words + (self._tails(carry)[0][1] if carry else [])

    def k_best(self, name: str, k: int) -> list[list[str]]:
        """The k first words with the best tails behind them, best first."""
        text = "".join(c for c in name.lower() if "a" <= c <= "z")
        if not text:
            return []
        best = self._tails(text)
        heads = [(self.logs.get(text[:j], UNKNOWN) + best[j][0], [text[:j], *best[j][1]]) for j in range(1, min(len(text), LIMIT) + 1)]
        return [w for _, w in sorted(heads, key=lambda x: -x[0])[:k]]


def segment_udf(counts: dict[str, float], total: float | None = None):
    """Arrow function name -> array of words. The vocabulary travels once with the function."""
    model = Segmenter(counts, total)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for names in parts:
            if len(known) > 200_000:
                known.clear()
            for n in names.dropna().unique():
                if n not in known:
                    known[n] = model.best(n)
            yield names.map(lambda n: known[n] if isinstance(n, str) else None)

    return run


def k_best_udf(counts: dict[str, float], k: int, total: float | None = None):
    model = Segmenter(counts, total)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: model.k_best(n, k) if isinstance(n, str) else None)

    return run


def prefixes(text: Column, limit: int = LIMIT) -> Column:
    """All ways to take a first word: (prefix, suffix)."""
    n = F.least(F.length(text), F.lit(limit))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(text, F.lit(1), i).alias("prefix"), F.substr(text, i + 1, F.length(text)).alias("suffix")))).otherwise(F.array().cast("array<struct<prefix:string,suffix:string>>"))


def native_segments(df: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """(name, words) by a fold in SQL, without Python: all substrings of distinct names
    are looked up in the vocabulary (word, logp), then tails are built from the end."""
    names = df.select(F.col(name).alias("name"), F.regexp_replace(F.lower(name), "[^a-z]", "").alias("t")).where("t <> ''").distinct()
    pieces = names.select("name", "t", F.explode(F.expr(f"flatten(transform(sequence(1, length(t)), i -> transform(sequence(1, least({LIMIT}, length(t) - i + 1)), k -> struct(i AS i, substr(t, i, k) AS w))))")).alias("p")).select("name", "t", "p.i", "p.w")
    scored = pieces.join(vocabulary, pieces["w"] == vocabulary["word"], "left").select("name", "t", "i", "w", F.coalesce("logp", F.lit(float(UNKNOWN))).alias("s"))
    rows = scored.groupBy("name", "t", "i").agg(F.collect_list(F.struct("w", "s")).alias("c")).groupBy("name", "t").agg(F.sort_array(F.collect_list(F.struct("i", "c")), False).alias("at"))
    fold = """aggregate(at, array(struct(0D AS s, CAST(array() AS array<string>) AS w)), (z, a) ->
        concat(array(array_max(transform(a.c, x -> struct(x.s + get(z, length(x.w) - 1).s AS s, concat(array(x.w), get(z, length(x.w) - 1).w) AS w)))), z), z -> z[0].w)"""
    return rows.select("name", F.expr(fold).alias("words"))


def word_ids(tokens: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Replace tokens by dense ids: ``vocabulary`` has (word, id), ids from 1; unknown tokens get 0.

    Each distinct list is looked up once and joined back to its rows, so repeated rows
    stay, and so do rows with an empty or null list (their ids are empty).
    """
    lists = tokens.select(F.col(column).alias("_list")).where("size(_list) > 0").distinct()
    long = lists.select("_list", F.posexplode("_list").alias("_pos", "word")).join(vocabulary.select("word", "id"), "word", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("id", F.lit(0)).alias("id")))), lambda p: p["id"])
    found = long.groupBy("_list").agg(ids.alias("ids"))
    rest = [c for c in tokens.columns if c != column]
    return tokens.join(found, F.col(column) == F.col("_list"), "left").select(*rest, F.coalesce("ids", F.array().cast(found.schema["ids"].dataType)).alias("ids"))
