"""Line dedup against brute force, at the default parameters and others; crowded buckets; odd inputs."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lapwing.llm import lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def threshold(n, bands):
    return max([k for lo, k in bands if n >= lo], default=0)


def variants(seed, groups, low, high, letters="abé ", per=5, edits=3):
    r, found = random.Random(seed), set()
    for _ in range(groups):
        base = "".join(r.choice(letters) for _ in range(r.randint(low, high)))
        found.add(base)
        for _ in range(per):
            s = list(base)
            for _ in range(r.randint(1, edits)):
                k = r.randrange(len(s))
                s[k : k + r.randint(0, 1)] = r.choice(["c", "é", "ab", "", "1"])
            found.add("".join(s))
    return sorted(x for x in found if x)


def classes_of(texts, bands):
    root = {x: x for x in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(texts)), 2):
        k = threshold(max(len(a), len(b)), bands)
        if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
            root[top(a)] = top(b)
    out = {}
    for x in set(texts):
        out.setdefault(top(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def got_classes(rows, text_of):
    out = {}
    for r in rows:
        out.setdefault(r["class_id"], set()).add(text_of[r["doc_id"], r["line_no"]])
    return sorted(map(sorted, out.values()))


CASES = {
    "default": (lines.BANDS, lines.HOT, variants(1, 14, 8, 60)),
    "around the bands": (lines.BANDS, lines.HOT, variants(2, 12, 8, 12, per=8) + variants(3, 12, 37, 43, per=8)),
    "crowded": (lines.BANDS, 2, variants(4, 10, 36, 60, per=14, edits=2)),
    "crowded, one base": (lines.BANDS, 1, variants(5, 1, 50, 50, per=60, edits=2)),
    "crowded, one edit": (((4, 1),), 1, variants(6, 3, 8, 14, letters="ab", per=40, edits=2)),
    "crowded, short": (((3, 2),), 1, variants(11, 5, 2, 5, letters="abcd", per=12, edits=2)),
    "three": (((6, 1), (12, 2), (24, 3)), 3, variants(7, 8, 8, 34, per=8, edits=4)),
}


@pytest.mark.parametrize("name", CASES)
def test_classes_equal_brute_force(spark, name):
    bands, hot, texts = CASES[name]
    rows = [(i, x) for i, x in enumerate(texts)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bands, hot).collect()
    want = classes_of(texts, bands)
    assert got_classes(got, {(i, 0): x for i, x in rows}) == want and len(want) < len(texts)
    kept = {texts[r["doc_id"]] for r in got if r["kept"]}
    assert kept == {min(c, key=texts.index) for c in want}


def test_links_are_links(spark):
    import hashlib

    texts = variants(8, 12, 8, 60)
    name = {hashlib.md5(x.encode()).hexdigest(): x for x in texts}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in lines.edit_links(d, hot=64).collect()}
    want = {p for p in itertools.combinations(sorted(texts), 2) if distance(*p) <= threshold(max(map(len, p)), lines.BANDS)}
    assert found == want and want  # small buckets: every link


def test_within(spark):
    r = random.Random(9)
    pairs = [(a, b) for a in variants(10, 3, 1, 14, letters="ab") for b in variants(10, 3, 1, 14, letters="ab") if r.random() < 0.2]
    d = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        near = f"transform(array(struct(split(a, '') AS x, split(b, '') AS y)), c -> {lines.within_sql('c.x', 'c.y', k)})[0]"
        for x in d.where(f"abs(length(a) - length(b)) <= {k}").select("a", "b", F.expr(near).alias("near")).collect():
            assert x["near"] == (distance(x["a"], x["b"]) <= k), x


def test_numbered_lines_cost_no_pairs(spark):
    """100,000 lines that differ in a number of twelve digits, in linear time; each is its own class."""
    n = 100_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("request %012d was answered by the second server of the first room", F.pmod(F.xxhash64("id"), F.lit(10**12))).alias("text"))
    began = time.time()
    got = lines.line_dedup(d).agg(F.count("*"), F.countDistinct("class_id"), F.count_if("kept")).first()
    assert tuple(got)[0] == n and got[1] == got[2] > 0.99 * n and time.time() - began < 150


def test_dense_numbers(spark):
    """1,000 lines that differ in a number of three digits: all are linked, by chains."""
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("request %03d was answered by the second server of the first room", "id").alias("text"))
    got = lines.line_dedup(d).collect()
    assert len({r["class_id"] for r in got}) == 1 and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_odd_rows(spark):
    same = "same line of some length, thirty and more"
    rows = [(1, f"{same}\n{same}\n\nother", "c"), (1, f"{same}\n{same}\n\nother", "c"), (2, None, "c"), (3, "", None), (4, "\n\n", "x"), (None, same + "!", "x"), (None, "short", "x"), (5, "x" * 1_000_000, "x"), (6, "x" * 999_999, "x"), (7, "short", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = lines.line_dedup(d).collect()
    assert len(got) == 6 + 1 + 1 + 2 + 1
    near = [r for r in got if r["line_no"] < 2 and (r["doc_id"] == 1 or r["line_id"] != r["class_id"] and r["doc_id"] is None)]
    assert len({r["class_id"] for r in near}) == 1 and sum(r["kept"] for r in near) == 1
    assert sum(r["kept"] for r in got) == 4  # the long line, other, short, one of the huge ones
    assert lines.line_dedup(d.limit(0)).count() == 0
    assert lines.line_dedup(d.where("doc_id IN (2, 3, 4)")).count() == 0


def wordy(seed, groups, low, high, per=6, edits=2):
    r, found = random.Random(seed), set()
    word = lambda: "".join(r.choice("taoinshrdlué") for _ in range(r.randint(1, 8)))
    for _ in range(groups):
        base = " ".join(word() for _ in range(r.randint(low, high)))
        found.add(base)
        for _ in range(per):
            s = list(base)
            for _ in range(r.randint(1, edits)):
                k = r.randrange(len(s))
                s[k : k + r.randint(0, 1)] = r.choice(["a", " ", "", " a", "é"])
            found.add("".join(s))
    return sorted(found)


def test_lines_of_words_file_few_keys(spark):
    """Five keys each and none to ask for; lines two edits apart share one of them if either has enough segments."""
    texts = wordy(12, 30, 20, 60)
    rows = spark.createDataFrame([(i, x, len(x), 0) for i, x in enumerate(texts)], "id long, line string, n int, sign int")
    keys = {}
    for r in lines._first_keys(rows, lines.BANDS).collect():
        keys.setdefault(r["id"], []).append(r["k"])
    enough = {r["id"] for r in lines._by_content(rows, lines.BANDS).where("enough").select("id").collect()}
    assert len(enough) > 0.5 * len(texts) and all(len(keys[i]) <= 5 for i in enough)
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if abs(len(texts[i]) - len(texts[j])) <= 2 and texts[i][:4] == texts[j][:4] and distance(texts[i], texts[j]) <= 2]
    assert near and all(set(keys[i]) & set(keys[j]) for i, j in near if i in enough or j in enough)


def test_crowded_words(spark):
    """Buckets of segments cut by content that are too large for pairs; a segment that occurs twice."""
    texts = wordy(13, 2, 24, 30, per=40) + wordy(14, 2, 1, 9, per=20)
    texts += [" ".join(["onward", "under the rain"] * 4)[:70] + x for x in ("", " a", "b", " of it", "ab")]
    texts = sorted(set(x for x in texts if x))
    got = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=2).collect()
    assert got_classes(got, {(i, 0): x for i, x in enumerate(texts)}) == classes_of(texts, lines.BANDS)


def copies(seed, n, words):
    """A line of so many words, with one or two of them exchanged in each copy; each fifth copy twice, two edits apart."""
    r, found = random.Random(seed), set()
    word = lambda: "".join(r.choice("etaoinshrdlumb") for _ in range(r.randint(4, 8)))
    base = [word() for _ in range(words)]
    for i in range(n):
        s = list(base)
        for _ in range(r.randint(1, 2)):
            s[r.randrange(words)] = word()
        text = " ".join(s)
        found.add(text)
        if i % 5 == 0:
            k = r.randrange(len(text) - 1)
            found.add(text[:k] + r.choice(["é", "x", ""]) + text[k + 1 :] + r.choice(["", "!"]))
    return sorted(found)


def test_copies_with_words_changed_take_no_levels(spark, monkeypatch):
    """A crowd that is no number's is parted by its counts of characters, and not cut again level by level."""
    texts, labels, staged = copies(15, 100, 11), [], lines.staged
    monkeypatch.setattr(lines, "staged", lambda df, label, *more: labels.append(label) or staged(df, label, *more))
    got = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=4).collect()
    want = classes_of(texts, lines.BANDS)
    assert got_classes(got, {(i, 0): x for i, x in enumerate(texts)}) == want and len(want) < len(texts)
    assert "line-hot-texts" in labels and "line-level" not in labels


@pytest.mark.parametrize("bands", [lines.BANDS, ((6, 1), (12, 2), (24, 3))])
def test_near_lines_share_the_counts_of_a_set(spark, bands):
    k = max(x for _, x in bands)
    texts = variants(16, 8, 30, 60, letters="etaoinshré bz,.", per=6, edits=k) + ["e" * 40, "e" * 17 + "t" * 23, "e" * 38]
    texts = [*texts, *(x[1:] + "q" for x in texts)]
    rows = spark.createDataFrame([(x, len(x)) for x in texts], "line string, n int")
    signs = [tuple(x) for x in rows.selectExpr(lines.crowd_sign_sql() + " AS sign", lines.crowd_more_sql() + " AS more").collect()]
    sets = lines._count_sets(k)
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if abs(len(texts[i]) - len(texts[j])) <= k and distance(texts[i], texts[j]) <= k]
    assert len(near) > 20 and len(sets) == 2 * k + 1
    assert all(any((signs[i][0] ^ signs[j][0]) & p == 0 and (signs[i][1] ^ signs[j][1]) & q == 0 for p, q in sets) for i, j in near)
