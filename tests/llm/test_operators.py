"""The operators against brute force, on small fixtures with nulls, empty and long texts,
ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lapwing.llm import bpe, exact, graph, html_text, packing, pii, quality, simhash
from lapwing.llm.html_pages import labelled_pages

TEXTS = [
    None, "", " \n\t ", "a", "The cat sat on the mat. " * 30, "the cat SAT on the mat. " * 30, "É é ß İ Σ ς  x", "word " * 3000, "<|endoftext|> it's I'LL 12 ½ 🎉 你好",
    "mail a.b@c.de, +1 (499) 555-6503 or 10.0.0.1 and 4111 1111 1111 1111", "same line of some length, thirty and more\nsame line of some length, thirty and more\nother",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "en", f"s{i}", 7, "clash", 1) for i, x in enumerate([*TEXTS, *TEXTS[3:6]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, votes string, t int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_library(spark, docs, empty, tokenizer):
    got = {r["doc_id"]: r for r in bpe.token_digests(docs).collect()}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.token_digests(empty).count() == 0
    both = bpe.decode_column(bpe.encode_column(docs)).select("doc_id", "token_ids", "decoded", "votes").collect()
    assert all(r["decoded"] == tokenizer.decode(r["token_ids"], skip_special_tokens=False) and r["votes"] == "clash" for r in both)


def test_bpe_random_words(tokenizer):
    model, r = bpe.word_bpe(bpe.default_vocabulary()), random.Random(5)
    for _ in range(3000):
        w = "".join(r.choice("aeinorst'éß,1 ") for _ in range(r.randint(1, 16)))
        assert model.encode(w).tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_bpe_full_tables(tokenizer, monkeypatch):
    """Dictionaries and pair tables that are emptied all the time change nothing."""
    for name in ("CACHE_CHUNKS", "CACHE_WORDS", "CACHE_PAIRS"):
        monkeypatch.setattr(bpe, name, 7)
    model, r = bpe.WordBpe(bpe.default_vocabulary()), random.Random(25)
    for _ in range(2000):
        t = "".join(r.choice("aeinorstTHé'ß,._!1  \n\x00\x1f\xa0²") for _ in range(r.randint(1, 60)))
        assert model.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_bpe_long_words(tokenizer):
    """One word of a megabyte is encoded in linear time, with and without marks after it."""
    model, r = bpe.word_bpe(bpe.default_vocabulary()), random.Random(35)
    long = "".join(r.choice(["th", "ing", "sch", "ção", "x"]) for _ in range(400_000))
    for t in (long, long + "?!", "a" * 1_000_000, "'" * 1_000_000):
        began = time.time()
        ids = model.encode(t)
        assert time.time() - began < 20 and model.decode(ids).replace(" ", "") == tokenizer.decode(ids.tolist(), skip_special_tokens=False).replace(" ", "")
    part = long[:3000]
    assert model.encode(part).tolist() == tokenizer.encode(part, add_special_tokens=False).ids


def test_bpe_recent_marks(tokenizer):
    """Marks that the tokenizer's Unicode version may not know, before and after older ones."""
    model, r = bpe.word_bpe(bpe.default_vocabulary()), random.Random(15)
    marks = "\u0301\u0323\u0308\u1dfa\u1aca\u1df7\u1df6\u0f71\u0591\u3099"
    fixed = ["a\u1dfa\u0301", "a\u1aca\u0301", "a\u1df7\u0301", "a\u1df6\u0301", "\u212b \u212a \u2000x\u2001", "e\u0323\u0302", "\u0344", "İ\u0301", "ǰ\u0323"]
    for w in fixed + ["".join(r.choice("aeİΣéкが中 ,'1" + marks * 2) for _ in range(r.randint(1, 8))) for _ in range(20_000)]:
        assert model.encode(w).tolist() == tokenizer.encode(w, add_special_tokens=False).ids, ascii(w)


def test_batches_are_bounded_by_bytes(spark):
    from lapwing.llm.common import ARROW_BYTES, _bytes, small_arrow_batches

    small_arrow_batches(spark)
    d = spark.range(200).select(F.repeat(F.lit("x"), 1 << 17).alias("text"))
    sizes = d.coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1).select([]).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 3 and max(r["n"] for r in sizes) < 2 * ARROW_BYTES
    assert [_bytes(x) for x in ("64m", "4194304b", "100", "-1", "2GB")] == [64 << 20, 4 << 20, 100, 1 << 62, 2 << 30]


def brute_counts(text):
    w = word_list(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    ls = [x for x in (text or "").split("\n") if word_list(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality_counts(docs, empty):
    for r in docs.join(quality.quality(docs), "doc_id").collect():
        want = brute_counts(r["text"])
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == docs.columns


def test_quality_verdict(spark):
    r = random.Random(1)
    prose = [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) for _ in range(80)).replace("e e", "e. e") + "." for _ in range(60)]
    prose = [re.sub(r"(\w+ \w+ \w+ \w+ \w+)", r"\1.", p) for p in prose]
    junk = [" ".join(w + "***" for w in p.split()) for p in prose[:6]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(prose + junk)], "doc_id long, text string")
    kept = {x["doc_id"] for x in quality.quality(d).where("kept").collect()}
    assert kept == set(range(60))


def test_quality_long_prose_is_kept(spark):
    """A book of few kinds of words: their share falls with the length, the text is no worse."""
    r = random.Random(11)
    kinds = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8))) for _ in range(700)]
    prose = lambda n: " ".join(x + "." * (k % 9 == 8) for k, x in enumerate(r.choices(kinds, k=n)))
    d = spark.createDataFrame([(i, prose(90)) for i in range(60)] + [(100, prose(12000)), (101, "same few words again and now. " * 30)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality.judged(d).collect()}
    assert got[100]["kept"] and got[100]["votes"][6] == 1 and got[101]["votes"][6] == 0


def test_quality_frequent_wrong_objection(spark):
    """One rule objects to nearly half of the clean texts (no full stops): it says little, they stay; junk goes."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    rows = [" ".join(word() + "." * (i % 5 < 3 and k % 9 == 8) for k in range(200)) for i in range(100)]
    junk = [" ".join(word() + "*!" for _ in range(200)) for _ in range(6)]
    got = {x["doc_id"]: x for x in quality.judged(spark.createDataFrame(list(enumerate(rows + junk)), "doc_id long, text string")).collect()}
    assert sum(got[i]["votes"][7] == 0 for i in range(100)) == 40
    assert [i for i in got if got[i]["kept"]] and {i for i in got if got[i]["kept"]} == set(range(100))


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")].append(r["doc_id"])
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for i in g}
    for counters in (1, 2, 1024):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_dedup(docs, counters).collect()}
        assert got == want
    assert exact.exact_dedup(empty).count() == 0
    assert exact.drop_copies(docs).columns == docs.columns and exact.drop_copies(docs).count() == len(groups)


def test_misra_gries_keeps_frequent_keys():
    r, m = random.Random(2), exact.MisraGries(10)
    keys = [r.choice("abc") if r.random() < 0.6 else str(r.random()) for _ in range(5000)]
    m.add(keys)
    assert len(m.counts) <= 10 and {k for k, n in collections.Counter(keys).items() if n > 5000 / 11} <= set(m.counts)


def brute_fingerprint(text):
    w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("dense", [2048, 3])
def test_simhash_links(spark, dense):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(20)]
    for base in fps[:6]:
        for _ in range(12):
            x = base
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense)
    got = dict(graph.components(edges).collect())
    want = components_of(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = collections.defaultdict(set)
    for i, c in enumerate(want):
        groups[c].add(signed[i])
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_simhash_documents(docs, empty):
    got = {r["doc_id"]: r for r in simhash.near_dedup(docs).collect()}
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    comp = components_of(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for i, r in enumerate(rows):
        assert got[r["doc_id"]]["fingerprint"] == f"{fps[i]:016x}" and got[r["doc_id"]]["component_id"] == rows[comp[i]]["doc_id"]
    assert simhash.near_dedup(empty).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in graph.components(path).collect()} == {0}
    assert graph.components(path.limit(0)).count() == 0


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in _BASE.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, empty):
    more = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.255", "4111-1111-1111-1111 4111  1111", "+1 (2) 3..4-5 678", "é🎉a@b.c 1.2.3.4", "7" * 3000, "1.1.1.1" * 200, "mail me (at) x (dot) org", 'token = "abcdef0123456789"', " - ".join(["12"] * 500)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, x) for i, x in enumerate(more)], "doc_id long, text string"))
    for r in d.join(pii.personal_data(d).select("doc_id", pii.spans_text("base").alias("b"), pii.spans_text("all").alias("a")), "doc_id").collect():
        assert [x for x in r["b"].split(",") if x] == brute_spans(r["text"])
        assert set(r["b"].split(",")) - {""} <= set(r["a"].split(","))
    assert pii.personal_data(empty).count() == 0


def test_pii_redaction(docs, empty):
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[9]["text"] == "mail <email>, <phone> or <ip> and <card>" and got[9]["n_chars"] == len(got[9]["text"])
    assert all(got[r["doc_id"]] == r for r in docs.collect() if r["doc_id"] != 9)
    assert pii.redact(docs).columns == docs.columns and pii.redact(empty).count() == 0


def test_pii_surroundings_and_masks(spark):
    """What the labelers see around each match, and masking across blocks, against the text itself."""
    r = random.Random(13)
    texts = ["tel 555-123-4567 or a@b.c,d@e.f", "password=abcdef123456 mail x@y.org" * 3, "é🎉" * 3000 + " ip 10.0.0.1 " + "z" * 9000 + " +1 (499) 555-6503", "1.2.3.4 5.6.7.8" * 700]
    texts += ["".join(r.choice(["a@b.c ", "x", "1.2.3.4", " 555-123-4567 ", "+1 (499) 555-6503", "é", ";", "token: abc123def456ghi ", "123-45-6789"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.candidates(d).collect():
        text = texts[row["doc_id"]]
        for c in row["cands"]:
            before, after = text[max(0, c["s"] - pii.BEFORE) : c["s"]].lower(), text[c["e"] : c["e"] + 1]
            glued = bool(re.search("[A-Za-z0-9]", before[-1:] + after))
            cue = bool(re.search(rf"(?<![a-z])(?:{pii._CUES})[^a-z]*$", before))
            assert c["votes"][4] == "10"[glued] and c["votes"][2] == "21"[cue]
    names = dict(enumerate(pii.KINDS))
    masked = {x["doc_id"]: x["text"] for x in pii.redact(d).collect()}
    for row in pii.personal_data(d).collect():
        text, out, end = texts[row["doc_id"]], [], 0
        for c in sorted(row["all"], key=lambda c: (c["s"], -c["e"])):
            if c["s"] >= end:
                out += [text[end : c["s"]], f"<{names[c['kind']]}>"]
            end = max(end, c["e"])
        assert masked[row["doc_id"]] == "".join(out) + text[end:]
        base = [c for c in row["all"] if c["kind"] < len(pii.BASE)]
        assert all(b["e"] <= c["s"] or c["e"] <= b["s"] for c in row["all"] if c["kind"] >= len(pii.BASE) for b in base)


def test_pii_many_matches_in_one_text(spark):
    """20,000 addresses in one text: work grows with the matches, not with their square."""
    d = spark.createDataFrame([(1, "mail name@host.org, " * 20_000), (2, None), (None, "1.2.3.4")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(d).select("doc_id", F.size("all").alias("n"), F.get("all", F.lit(19_999))["s"].alias("last")).collect()}
    assert got[1]["n"] == 20_000 and got[1]["last"] == 20 * 19_999 + 5 and got[None]["n"] == 1
    assert time.time() - began < 40
    assert pii.redact(d).where("doc_id = 1").first()["text"] == "mail <email>, " * 20_000


def test_pii_added_spans(spark):
    """Planted personal data of the wider kinds, with look-alikes that aren't any."""
    r, rows, want = random.Random(14), [], {}
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    for i in range(400):
        filler = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(12))
        planted = [f"reach ann{i} [at] host{i}.org ", f"call {r.choice('234567')}{digits(2)}-{digits(3)}-{digits(4)} ", f"ssn {r.choice('12345')}{digits(2)}-{digits(2)}-{digits(4)} ", f"api_key = {digits(6)}abcDEF{digits(6)} "]
        decoys = ["000-00-0000 ", "token: aaaaaaaaaaaa ", "555-555-5555x ", ""]
        text, mine = filler + " ", []
        for x in r.sample(planted, 2):
            head = re.match(r"(?:reach|call|ssn) |", x)[0]
            mine.append((len(text) + len(head), len(text) + len(x.rstrip())))
            text += x
        text += r.choice(decoys) + filler
        rows.append((i, text))
        want[i] = set(mine)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: {(c["s"], c["e"]) for c in x["all"]} for x in pii.personal_data(d).collect()}
    hit = sum(len(got[i] & want[i]) for i in want)
    assert hit >= 0.95 * sum(map(len, want.values())) and hit >= 0.9 * sum(map(len, got.values()))


def test_packing(docs, empty, tokenizer):
    rows = packing.pack(docs, capacity=256).collect()
    pieces, places = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        want = {k: (256 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids[s : s + 256] for s in range(0, len(ids), 256))}
        assert pieces[d["doc_id"]] == want
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 256
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 256) + 1
    assert packing.pack(empty).count() == 0


def test_fullest_is_best():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        used = packing.fullest(counts, room)
        best = max(s for n in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * x for k, x in zip(counts, n, strict=True))) <= room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_each_piece_once():
    r = random.Random(6)
    histogram = dict(collections.Counter(min(2048, int(r.paretovariate(0.7) * 20)) for _ in range(20000)))
    used = collections.Counter()
    for combination, times in packing.plan(histogram):
        assert sum(k * n for k, n in combination.items()) <= 2048
        for k, n in combination.items():
            used[k] += n * times
    assert used == histogram


def test_html_held_out():
    weights, right, total = html_text.trained(), 0, 0
    for page in labelled_pages(100, seed=99):
        nodes, texts = html_text.parse(page)
        keep = html_text.judge(nodes, weights)
        right += sum((keep[k] >= 0.5) == nodes[k].label for k, _ in texts)
        total += len(texts)
    assert right / total > 0.98


def test_html_marginals_equal_enumeration():
    nodes, _ = html_text.parse("<div><p>a</p><nav><a href=x>b</a></nav><div class=content>c</div></div>")
    for n in nodes:
        n.kind = html_text._edge_kind(n)
    r = random.Random(8)
    scores, edges = [r.uniform(-2, 2) for _ in nodes], [r.uniform(0.3, 3) for _ in range(12)]
    total, mass = 0.0, [0.0] * len(nodes)
    for states in itertools.product([0, 1], repeat=len(nodes)):
        w = 1.0
        for k, n in enumerate(nodes):
            w *= np.exp(scores[k] * states[k])
            if k:
                w *= edges[4 * nodes[n.parent].kind + 2 * states[n.parent] + states[k]]
        total += w
        mass = [m + w * s for m, s in zip(mass, states, strict=True)]
    assert np.allclose(html_text.marginals(nodes, scores, edges)[0], [m / total for m in mass])


def test_html_deep_and_odd_pages():
    """Deep nesting with stray tags in linear time; pages without blocks; what is dropped and what isn't."""
    weights = html_text.trained()
    for page in ("<div>" * 20_000 + "x</p>" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000, "<select>" * 20_000 + "<p>x", "<ul><li>" * 10_000 + "x" + "</li></ul>" * 10_000, "word " * 200_000):
        began = time.time()
        html_text.main_text(page, weights)
        assert time.time() - began < 10
    assert html_text.main_text("just plain text\n of  one page &amp; more", weights) == "just plain text of one page & more"
    assert html_text.main_text("<b>bold</b> text<br>next", weights) == "bold text next"
    body = "<article><p>Some sentence of the article, long enough to be one. {} It goes on and ends here.</p></article>"
    text = "Some sentence of the article, long enough to be one. {} It goes on and ends here."
    for inner, shown in (("<math><mi>x</mi></math>", "x"), ("<svg><text>label</text></svg>", "label"), ("<select><option>a</select>", ""), ("<video>", ""), ("<script>a</script>", "")):
        assert html_text.main_text(body.format(inner), weights) == " ".join(text.format(shown).split())


def brute_stack(page):
    """(tag, parent's tag) of nodes, by walking the whole stack at each tag."""
    stack, out = ["body"], []
    for closing, tag in re.findall(r"<(/?)([a-z0-9]+)>", page):
        if closing:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k] == tag), 0)
            if at:
                del stack[at:]
            continue
        if stack[-1] == "p" or (tag in html_text._HEADINGS and stack[-1] in html_text._HEADINGS):
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k] in html_text._CLOSES.get(tag, ()):
                del stack[k:]
            elif stack[k] in html_text._BOUNDS:
                break
        out.append((tag, stack[-1]))
        stack.append(tag)
    return out


def test_html_tree_equals_walking_the_stack():
    r = random.Random(16)
    for _ in range(500):
        page = "".join(f"<{r.choice(['', '', '/'])}{r.choice(['div', 'ul', 'ol', 'li', 'p', 'table', 'tr', 'td', 'th', 'tbody', 'h2', 'dl', 'dt', 'dd'])}>" for _ in range(60))
        nodes, _ = html_text.parse(page)
        assert [(n.tag, nodes[n.parent].tag) for n in nodes[1:]] == brute_stack(page)


def test_html_texts(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=/>menu</a></nav><article><h1>Head &amp; more</h1><p><b>First\n one.<br>Two<p>Next &lt;b&gt;</p><div class=ad>buy</div></article><footer>foot</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain"), (1, "u", page), (1, "u", page), (4, "u", "<article><p>cut off text <a hre")], "page_id long, url string, html string")
    rows = rows.withColumn("text", F.lit("clash"))
    out = html_text.extract(rows).collect()
    assert len(out) == 7 and len({r["text"] for r in out if r["page_id"] == 1}) == 1 and html_text.extract(rows.limit(0)).count() == 0
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out}
    assert got[None] == ("plain", 5)
    assert got[1][0] == "Head & more\nFirst one. Two\nNext <b>" and got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "cut off text"
