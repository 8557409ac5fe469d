"""Each stage of the pipeline in order, and all of it, with nulls, repeated rows, shared doc_ids and clashing columns."""

import collections
import random

import pytest

import corpus_pipeline
from lapwing.llm import exact, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, votes string, `row` int"


def prose(seed, n=60):
    r = random.Random(seed)
    kinds = "the of and river stone mill under old house walked slowly from door which many years before they found water in hill".split()
    return " ".join(r.choice(kinds) + "." * (k % 9 == 8) for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [
        (1, a), (2, a.upper()), (3, a), (3, a), (4, b), (4, c), (5, c), (None, prose(4)), (None, prose(4)), (None, prose(5)), (None, None),
        (6, None), (7, ""), (8, prose(6) + " 10.0.0.1 and a.b@c.de"), (9, " ".join(f"{w}###" for w in prose(7).split())), (10, prose(8, 4000)),
        (11, prose(9, 400)), (12, prose(9, 400) + " more"), (12, prose(9, 400) + " more"), (13, prose(9, 400)),
    ]
    rows += [(100 + k, prose(1000 + k)) for k in range(40)]
    return spark.createDataFrame([(i, x, "en", f"s{i}", len(x or ""), "clash", 1) for i, x in rows], SCHEMA).cache()


def texts(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_exact_keeps_one_row_of_each_text(spark, docs):
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    low = lambda t: (t or "").lower()
    want = {}
    for r in docs.collect():
        want[low(r["text"])] = max(want.get(low(r["text"]), -1), -1 if r["doc_id"] is None else r["doc_id"])
    found = texts(got)
    assert all(n == 1 for n in found.values()) and len(found) == len(want)
    assert {low(t): -1 if i is None else i for i, t in found} == want
    assert exact.drop_copies(spark.createDataFrame([(1, "same"), (1, "same"), (2, "x")], "doc_id long, text string")).count() == 2
    assert exact.drop_copies(docs.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark, docs):
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    groups = {}
    prints = [(r["doc_id"], r["text"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    for _, _, p in prints:
        groups[p] = p
    for _ in groups:
        for p in groups:
            groups[p] = min([groups[q] for q in groups if (p ^ q).bit_count() <= 4] + [groups[p]])
    want = collections.defaultdict(list)
    for i, _, p in prints:
        want[groups[p]].append(i)
    kept = collections.Counter(groups[simhash.fingerprint(r["text"])] for r in got.collect())
    assert kept == dict.fromkeys(want, 1)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in want.items()}
    assert all(r["doc_id"] == smallest[groups[simhash.fingerprint(r["text"])]] for r in got.collect())
    assert simhash.drop_near_copies(spark.createDataFrame([(1, "same"), (1, "same"), (2, "x")], "doc_id long, text string")).count() == 2
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_stages_in_order(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    table, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, table = table, corpus_pipeline.staged(stage(spark, table, ""), "test-stage")
        assert table.columns == docs.columns, name
        if name != "pii":
            assert not texts(table) - texts(before)
        seen.append(table.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    ids = [r["doc_id"] for r in table.collect()]
    assert not {6, 7, 9} & set(ids) and {8, 10, 100} <= set(ids) and len({11, 12, 13} & set(ids)) == 1
    masked = table.where("doc_id = 8").first()
    assert masked["text"].endswith("<ip> and <email>") and masked["n_chars"] == len(masked["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == collections.Counter(ids)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in by_sequence.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 2048
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in rows)


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
