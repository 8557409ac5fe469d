"""Weak supervision in SQL: expectation-maximisation over vote patterns, and a
logistic model fitted to its posteriors.

Voters say 1 (positive), 0 (negative) or -1 (abstain). Rows with equal votes are
alike, so the models are fitted to the counts of vote patterns: a table with at most
3^voters rows whatever the input's size. That bound is what lets one row hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EM_ROUNDS = 60
#: Rows that are added to each count, so that no rate is 0 or 1.
PSEUDO = 1.0
FIT_ROUNDS = 150


def vote_patterns(votes: DataFrame, column: str = "votes") -> DataFrame:
    """(votes, n): how often each array of votes occurs; each task sums its own first."""
    return votes.groupBy(column).agg(F.count("*").alias("n")).withColumnRenamed(column, "votes")


def em_posteriors(patterns: DataFrame, voters: int, prior: float = 0.5) -> DataFrame:
    """(votes, n, posterior): probability that a row with these votes is positive.

    A voter's accuracy is how often it says positive where it votes, on positive rows (a)
    and on negative rows (b). Both, and the share of positive rows (p), are estimated from
    all rows, with ``PSEUDO`` rows of either vote added; nothing else holds them. Rows start
    with their share of positive votes (``prior`` counting as one vote), and rates and
    posteriors are worked out in turn. A vote then weighs what the rates make it weigh,
    against its own words too; abstaining says nothing, and a row on which all abstain gets
    p. An empty table gives an empty result.
    """
    j = f"sequence(0, {voters - 1})"
    begin = f"""transform(ps, r -> struct(r.votes AS votes, r.n AS n,
        ({prior}D + size(filter(r.votes, v -> v = 1))) / (1D + size(filter(r.votes, v -> v >= 0))) AS q))"""

    def rate(weight: str) -> str:
        says = f"aggregate(w, {PSEUDO}D, (z, r) -> z + CASE WHEN get(r.votes, j) = 1 THEN {weight} ELSE 0D END)"
        votes = f"aggregate(w, {2 * PSEUDO}D, (z, r) -> z + CASE WHEN get(r.votes, j) >= 0 THEN {weight} ELSE 0D END)"
        return f"{says} / {votes}"

    good, all_ = f"aggregate(w, {PSEUDO}D, (z, r) -> z + r.n * r.q)", f"aggregate(w, {2 * PSEUDO}D, (z, r) -> z + r.n)"
    odds = f"""transform({j}, j -> transform(array(struct({rate("r.n * r.q")} AS a, {rate("r.n * (1 - r.q)")} AS b)), x -> struct(ln(x.a / x.b) AS yes, ln((1 - x.a) / (1 - x.b)) AS no))[0])"""
    fit = f"struct({odds} AS o, ln({good} / ({all_} - {good})) AS p)"
    logit = f"aggregate({j}, m.p, (z, j) -> z + CASE get(r.votes, j) WHEN 1 THEN get(m.o, j).yes WHEN 0 THEN get(m.o, j).no ELSE 0D END)"
    step = f"transform(array({fit}), m -> transform(w, r -> struct(r.votes AS votes, r.n AS n, 1D / (1D + exp(-({logit}))) AS q)))[0]"
    one = patterns.select(F.struct("votes", F.col("n").cast("double").alias("n")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("ps")).where("size(ps) > 0")
    done = one.selectExpr(f"inline(aggregate(sequence(1, {EM_ROUNDS}), {begin}, (w, i) -> {step}))")
    return done.select("votes", F.col("n").cast("long").alias("n"), F.col("q").alias("posterior"))


def logistic_scores(rows: DataFrame, features: int, rate: float = 2.0, decay: float = 1e-3) -> DataFrame:
    """Fit a logistic model to (x array<double>, y double, n long) and score each x.

    Full-batch gradient descent with weight decay; x and y lie in [0, 1], and the rows
    must be few (vote patterns). Returns the rows with ``score`` added.
    """
    j = f"sequence(0, {features - 1})"
    dot = f"aggregate({j}, 0D, (z, j) -> z + get(w, j) * get(r.x, j))"
    score = f"1D / (1D + exp(-({dot})))"
    slope = "aggregate(e, 0D, (z, r) -> z + r.d * get(r.x, j))"
    step = f"""transform(array(transform(ps, r -> struct(r.x AS x, r.n / total * ({score} - r.y) AS d))), e ->
        transform({j}, j -> get(w, j) * (1 - {rate * decay}D) - {rate}D * {slope}))[0]"""
    fitted = f"transform(array(greatest(1e-9D, aggregate(ps, 0D, (z, r) -> z + r.n))), total -> aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {features}), (w, i) -> {step}))[0]"
    one = rows.select(F.struct("x", "y", F.col("n").cast("double").alias("n"), F.struct(*[c for c in rows.columns if c not in ("x", "y", "n")]).alias("key")).alias("r"))
    one = one.agg(F.sort_array(F.collect_list("r")).alias("ps")).where("size(ps) > 0")
    done = one.selectExpr(f"transform(array({fitted}), w -> transform(ps, r -> struct(r.key AS key, r.x AS x, r.y AS y, r.n AS n, {score} AS score)))[0] AS ps")
    return done.selectExpr("inline(ps)").select("key.*", "x", "y", F.col("n").cast("long").alias("n"), "score")
