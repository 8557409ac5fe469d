"""Toxicity: the kernel and the SVM against brute force, odd inputs, held-out recall."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from lapwing.llm import toxicity


def brute_kernel(a, b):
    """Shared subsequences of three characters over spans of at most five, and runs of four."""
    def vector(w):
        w, out = f"^{w}$", {}
        for at in itertools.combinations(range(len(w)), 3):
            if at[2] - at[0] <= 4:
                key = "".join(w[k] for k in at)
                out[key] = out.get(key, 0) + 0.5 ** (at[2] - at[0] - 2)
        for k in range(len(w) - 3):
            key = w[k : k + 4]
            out[key] = out.get(key, 0) + 1.0
        return out

    x, y = vector(a), vector(b)
    return sum(v * y.get(s, 0) for s, v in x.items()) / (toxicity._norm(len(a)) * toxicity._norm(len(b)))


WORDS = ["idiot", "id.iot", "idxiot", "table", "stable", "aaaa", "moron", "ab"]


def test_kernel_equals_brute_force():
    k = toxicity.Kernel(WORDS)
    for a, b in itertools.product(WORDS, WORDS):
        assert np.isclose(k.counts(a) @ k.counts(b), brute_kernel(a, b))
        # landmarks' Nyström features give their kernel back
        if len(a) > 2 < len(b):
            assert np.isclose(k.features(a) @ k.features(b), brute_kernel(a, b), atol=1e-4)
    assert brute_kernel("idiot", "idxiot") > 0.4 > brute_kernel("idiot", "table")


def test_sentence_scores_are_sums():
    k = toxicity.Kernel(WORDS)
    w = np.random.default_rng(1).normal(size=k.project.shape[1])
    flat = k.project @ w
    model = toxicity.WordModel({s: float(flat[i]) for s, i in k.index.items()})
    known = toxicity._Missing(k.features, 100)
    for words in (["idiot", "table"], ["(Moron)!".lower(), "x" * 50 + "idiot" + "y" * 60], ["ab"]):
        assert np.isclose(sum(map(model.word, words)), k.sentences([words], known)[0] @ w, atol=1e-4)


def test_svm_is_optimal():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(1, 1, (40, 5)), r.normal(-1, 1, (60, 5))])
    y, c = np.array([1.0] * 40 + [-1.0] * 60), np.full(100, 0.01)
    w = toxicity.fit_svm(x, y, c, 0.01)
    loss = lambda w: (c * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum() + 0.01 * (w[:-1] ** 2).sum()
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in r.normal(0, 0.05, (200, 6)))


def test_units():
    assert toxicity.units("You i d i o t " + "x" * 500) == ["you", "idiot", "x" * 500]
    assert toxicity.units("a b and a b") == ["a", "b", "and"] and toxicity.units(" ") == []
    assert ["".join(p) for p in toxicity.sentences(["a", "b.", "c"])] == ["ab.", "c"]
    assert max(map(len, toxicity.sentences(["w"] * 100))) == toxicity.SPANS[0]
    assert all(len(p) <= toxicity.PIECE for p in toxicity.pieces("x" * 1000)) and any("idiot" in p for p in toxicity.pieces("x" * 38 + "idiot" + "x" * 90))


@pytest.fixture(scope="module")
def case():
    r = random.Random(9)
    plain = ["".join(r.choice("etaoinshr") for _ in range(r.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        w = r.choices(plain, k=40) + ["blargh", "zonkwit"][: toxic * 2]
        r.shuffle(w)
        rows.append((i, " ".join(w), "en", 0.5))
        labels.append((i, 1, toxic))
    odd = ["nothing to see here", "you bl.ar-gh person", None, "z o n k w i t", "", " ".join(r.choices(plain, k=60_000)), "x" * 300_000, " ".join(r.choices(plain, k=30_000)) + " you blargh zonkwit", rows[0][1], rows[0][1]]
    rows += [(1000 + k, x, None, None) for k, x in enumerate(odd)] + [(1009, odd[9], "en", 1.0), (None, "you blargh zonkwit", "en", 0.0)]
    return rows, labels


def test_toxicity(spark, case):
    rows, labels = case
    # columns with names of the result's own
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(d, lab).collect()
    assert len(out) == len(rows)
    got = {x["doc_id"]: x for x in out}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows if i is not None) and not got[None]["held_out"]
    assert sum(got[i]["predicted"] != t for i, _, t in labels) <= 3
    assert [got[1000 + k]["predicted"] for k in (0, 2, 3, 4, 5, 6, 7)] == [0, 0, 1, 0, 0, 0, 1] and got[None]["predicted"] == 1
    assert got[1001]["score"] > got[1000]["score"] and got[1002]["score"] == got[1004]["score"] and got[1008]["score"] == got[0]["score"]
    assert len({x["score"] for x in out if x["doc_id"] == 1009}) == 1
    assert all(x["predicted"] == int(x["score"] >= 0.5) and 0 <= x["score"] <= 1 for x in out)
    assert toxicity.score(d.limit(0), lab).count() == 0 and toxicity.score(d, lab.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score(d, lab.where("toxic = 1")).where("score <> 0").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_recall(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    caught = [r["predicted"] for r in got if r["toxic"]]
    false = [r["predicted"] for r in got if not r["toxic"]]
    assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false)
