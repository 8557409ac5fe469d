"""Expectation-maximisation and the logistic model against NumPy, on planted accuracies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import quality, weak


def numpy_em(votes, n, rounds=weak.EM_ROUNDS, pseudo=weak.PSEUDO, prior=0.5):
    yes, voted = votes == 1, votes >= 0
    q = (prior + yes.sum(1)) / (1 + voted.sum(1))
    for _ in range(rounds):
        a = (pseudo + (n * q) @ yes) / (2 * pseudo + (n * q) @ voted)
        b = (pseudo + (n * (1 - q)) @ yes) / (2 * pseudo + (n * (1 - q)) @ voted)
        p = (pseudo + n @ q) / (2 * pseudo + n.sum())
        z = np.log(p / (1 - p)) + yes @ np.log(a / b) + (voted & ~yes) @ np.log((1 - a) / (1 - b))
        q = 1 / (1 + np.exp(-z))
    return q, a, b


@pytest.fixture(scope="module")
def planted():
    """20,000 rows, 30 % of them bad; six voters of known accuracies, the last one a guess."""
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.7
    good, bad = np.array([0.95, 0.9, 0.8, 0.97, 0.6, 0.5]), np.array([0.1, 0.3, 0.2, 0.5, 0.25, 0.5])
    votes = (r.random((20_000, 6)) < np.where(truth[:, None], good, bad)).astype(int)
    votes[r.random(votes.shape) < 0.15] = -1
    return truth, votes, good, bad


def test_em_equals_numpy_and_finds_planted_accuracies(spark, planted):
    truth, votes, good, bad = planted
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    want, a, b = numpy_em(patterns, counts.astype(float))
    assert np.abs(a - good).max() < 0.03 and np.abs(b - bad).max() < 0.06
    table = spark.createDataFrame([(v.tolist(), int(n)) for v, n in zip(patterns, counts, strict=True)], "votes array<int>, n long")
    got = {tuple(r["votes"]): r["posterior"] for r in weak.em_posteriors(table, 6).collect()}
    assert np.allclose([got[tuple(v)] for v in patterns.tolist()], want, atol=1e-6)
    kept = np.array([got[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (kept == truth).mean() > 0.93
    assert weak.em_posteriors(table.limit(0), 6).count() == 0


def test_vote_patterns(spark):
    rows = spark.createDataFrame([([1, 0],), ([1, 0],), ([-1, 1],)], "votes array<int>")
    assert {tuple(r["votes"]): r["n"] for r in weak.vote_patterns(rows).collect()} == {(1, 0): 2, (-1, 1): 1}


def test_logistic_equals_numpy(spark):
    r = np.random.default_rng(4)
    x = np.hstack([np.ones((12, 1)), r.integers(0, 2, (12, 3))]).astype(float)
    y, n = r.random(12), r.integers(1, 50, 12)
    w = np.zeros(4)
    for _ in range(weak.FIT_ROUNDS):
        d = n / n.sum() * (1 / (1 + np.exp(-x @ w)) - y)
        w = w * (1 - 2.0 * 1e-3) - 2.0 * x.T @ d
    rows = spark.createDataFrame([(i, a.tolist(), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, n, strict=True))], "i int, x array<double>, y double, n long")
    got = {g["i"]: g["score"] for g in weak.logistic_scores(rows, 4).collect()}
    assert np.allclose([got[i] for i in range(12)], 1 / (1 + np.exp(-x @ w)), atol=1e-9)


def test_one_objection_of_an_unreliable_rule(spark):
    """A rule that is wrong on a tenth of the clean texts: its objection alone rejects nothing. Two that agree do."""
    rules = len(quality.RULES)
    clean, one, junk = [1] * rules, [1] * (rules - 1) + [0], [0, 1, 1, 1, 1, 1, 1, 1, 0, 0]
    table = spark.createDataFrame([(clean, 8000), (one, 900), (junk, 1000)], "votes array<int>, n long")
    got = {tuple(r["votes"]): r["posterior"] for r in weak.em_posteriors(table, rules).collect()}
    assert got[tuple(one)] > 0.5 > got[tuple(junk)]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_agreement_with_labels(spark, sf):
    d = f"/root/testdata/{sf}"
    try:
        docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    except Exception:
        pytest.skip("no test tables")
    rows = quality.quality(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    got = {r["quality"]: (r["kept"], r["n"]) for r in rows}
    assert got[1][0] >= 0.98 * got[1][1] and got[0][0] <= 0.1 * got[0][1]
