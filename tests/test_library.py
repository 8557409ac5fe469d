"""Prototypes, segmentation, sources, fixpoints, flows and streams on small inputs."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lapwing.functions import prototypes as P
from lapwing.functions.segment import LIMIT, Segmenter, native_segments
from lapwing.functions.vectors import centroids, l2_normalise
from lapwing.operators import dataflow, lookups, ordering, sampling, selection, summaries
from lapwing.plans import analysis, propagate
from lapwing.sources import files
from lapwing.streaming import streams


def names(df, *columns):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect())


def test_prototype(spark):
    lines = ["void * kmalloc_array(size_t n, size_t size, gfp_t flags)", "int f(void)", "static char **g(int (*cb)(int), struct a *b)", "no parentheses", "int h()"]
    got = analysis.raw_prototypes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert names(got, "funcname", "return_type", "params") == [
        ("f", "int", ""),
        ("g", "static char **", "void *@ptr,struct a *@b,"),
        ("h", "int", ""),
        ("kmalloc_array", "void *", "size_t@n,size_t@size,gfp_t@flags,"),
    ]
    piped = got.where("funcname = 'kmalloc_array'").select(P.piped(F.col("return_type"), F.col("funcname"), F.col("params"))).first()[0]
    assert piped == "|void *@kmalloc_array||size_t@n||size_t@size||gfp_t@flags|"


def test_tokens(spark):
    counts = {"kmalloc": 50.0, "array": 40.0, "n": 10.0, "size": 30.0, "flags": 20.0}
    protos = analysis.raw_prototypes(spark.createDataFrame([("void * kmalloc_array(size_t n, size_t size, gfp_t flags)",), (f"int {'x' * 151}(int n)",), ("void size()",)], "value string"))
    got = dict(analysis.tokens_of(protos, counts).select("funcname", F.array_join("tokens", " ")).collect())
    assert got == {"kmalloc_array": "<cls> <ptr> kmalloc array ( <noptr> n <dot> <noptr> size <dot> <noptr> flags )", "size": "<cls> <noptr> size ( )"}


def brute_best(text, logs):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        words, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                words.append(text[at:i])
                at = i
        if max(map(len, words)) <= LIMIT:
            score = 0.0
            for w in reversed(words):
                score = logs.get(w, -99999999999999999) + score
            if best is None or (score, words) > best:
                best = (score, words)
    return best[1]


def test_segmenter(spark):
    r = random.Random(1)
    counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): float(r.randint(1, 9)) for _ in range(14)} | {"a": 1.0, "b": 1.0}
    s = Segmenter(counts)
    texts = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 11))) for _ in range(40)})
    for text in texts:
        assert s.best(text) == brute_best(text, s.logs), text
    logs = spark.createDataFrame([(w, v) for w, v in s.logs.items()], "word string, logp double")
    native = dict(native_segments(spark.createDataFrame([(x,) for x in texts], "name string"), "name", logs).collect())
    assert native == {x: s.best(x) for x in texts}
    assert [w[0] for w in s.k_best("abab", 3)] and s.k_best("", 3) == [] and s.best("_1") == []


def test_call_graph_source(spark, tmp_path):
    def line(name, callees, **more):
        head = json.dumps({"return_type": "void", "funcname": name, "params": "", "file": "a.c", **more})
        return "\n".join([head, *("\t" + json.dumps({"return_type": "int", "funcname": c, "params": ""}) for c in callees)])

    path = tmp_path / "graph.json"
    path.write_text("\n".join([line("a", ["x", "x", "y"]), line("b", []), line("a", ["x", "z"]), line("a", ["p", "q", "r"]), line("last", ["a"])]) + "\n")
    groups = files.read_call_graph(spark, str(path))
    e = files.edges(groups)
    g = groups.select(F.col("caller.funcname").alias("caller"), "pos")
    assert names(summaries.compacted(e, g), "caller", "callee", "number") == [("a", "p", 1), ("a", "q", 1), ("a", "r", 1), ("last", "a", 1)]
    assert names(files.read_callers(spark, str(path)), "funcname") == ["a", "a", "a", "b", "last"]
    files.write_call_graph(groups, str(tmp_path / "out"))
    assert files.read_call_graph(spark, str(tmp_path / "out")).count() == 5


def test_text_sources(spark, tmp_path):
    (tmp_path / "sim").write_text("alloc 0.5\nlong name 0.25\n")
    assert names(files.read_similarity(spark, str(tmp_path / "sim")), "funcname", "cos") == [("alloc", 0.5), ("longname", 0.25)]
    (tmp_path / "tok").write_text("<cls> a\n<cls> b c\n\nmax_length:3")
    assert names(files.read_token_lines(spark, str(tmp_path / "tok")), F.array_join("tokens", " ")) == ["<cls> a", "<cls> b c"]
    (tmp_path / "vocab").write_text("<total>\t100\nab\t10\n")
    assert math.isclose(files.read_vocabulary(spark, str(tmp_path / "vocab")).first()["logp"], -1)
    (tmp_path / "db.json").write_text(json.dumps([{"directory": "d", "arguments": ["cc", "-D__GENKSYMS__", "a.c"], "file": "a.c"}]))
    assert files.read_compile_db(spark, str(tmp_path / "db.json"), add="-g").first()["command"] == "cc  a.c -g"
    (tmp_path / "free").write_text(json.dumps({"funcname": "f", "param_names": [0, "p", "<nops>"], "member_name": ["<nops>"]}))
    row = files.read_free_flows(spark, str(tmp_path / "free")).first()
    assert [tuple(p) for p in row["params"]] == [(0, "p")] and row["members"] == []


def test_selection(spark):
    f = spark.createDataFrame([("a", "void *", "", "x.c"), ("b", "int", "int@n,", "x.c"), ("c", "void", "char *@p,", "y.h"), ("d", "struct s *", "", "x.c")], "funcname string, return_type string, params string, file string")
    sim = spark.createDataFrame([("a", 0.99), ("b", 0.99), ("c", 0.6), ("d", 0.97), ("m", 0.5), ("edge", 0.5)], "funcname string, cos double")
    e = spark.createDataFrame([("a", "m", 2), ("d", "m", 2), ("c", "a", 1), ("c", "m", 1)], "caller string, callee string, number int")
    assert names(selection.alloc_candidates(f, sim), "funcname") == ["a", "c", "d"]
    assert names(selection.special_allocators(f, e, sim), "funcname") == ["a"]  # d returns a struct and allocates twice
    found, used = selection.free_candidates(f, e, sim)
    assert names(found, "funcname") == ["c"] and names(used, "callee") == ["a"]
    assert names(selection.by_extension(f, ".h"), "funcname") == ["c"]


def test_targets_stop_at_malloc(spark):
    e = spark.createDataFrame([("f", 0, 0, "k", "void *"), ("f", 0, 1, "malloc", "void *"), ("f", 0, 2, "z", "void *"), ("g", 0, 0, "q", "int")], "caller string, pos long, nth int, callee string, return_type string")
    belief = spark.createDataFrame([("k", 1), ("z", 1), ("q", 0)], "funcname string, belief int")
    sim = spark.createDataFrame([("q", 0.9)], "funcname string, cos double")
    assert names(lookups.target_callees(e, belief, sim), "caller", "callee") == [("f", "k"), ("f", "malloc")]


def test_null_checks(spark):
    e = spark.createDataFrame([("f", 1), ("f", 1), ("f", 0), ("f", 0), ("g", 9)], "funcname string, arg_index int")
    assert names(summaries.null_checks(e), "funcname", "arg_index", "n") == [("f", 0, 2), ("g", 0, 0)]


def test_depths_and_cycles(spark):
    e = spark.createDataFrame([("a", "seed"), ("b", "a"), ("c", "b"), ("c", "seed"), ("x", "y"), ("y", "x"), ("s", "s"), ("seed", "a")], "caller string, callee string")
    seeds = spark.createDataFrame([("seed",)], "funcname string")
    cand = spark.createDataFrame([(n,) for n in "abcxys"], "funcname string")
    got = dict(propagate.call_depths(e.where("caller <> 'seed'"), seeds, cand).collect())
    assert got == {"seed": 1, "a": 2, "b": 3, "c": 4}
    assert names(propagate.reach(e, seeds), "funcname") == ["a", "b", "c", "seed"]


def test_depths_of_a_long_chain(spark):
    calls = [(f"f{i}", f"f{i - 1}") for i in range(1, 35)] + [("f34", "f0"), ("f20", "f20"), ("g", "f30")]
    e = spark.createDataFrame(calls, "caller string, callee string")
    cand = spark.createDataFrame([(n,) for n in {c for c, _ in calls}], "funcname string")
    seeds = spark.createDataFrame([("f0",)], "funcname string")
    got = dict(propagate.call_depths(e, seeds, cand).collect())
    assert got == {f"f{i}": i + 1 for i in range(35)} | {"g": 32}
    with pytest.raises(ValueError, match="cycle"):
        propagate.call_depths(e.union(spark.createDataFrame([("f3", "f5")], "caller string, callee string")), seeds, cand)


def test_belief(spark):
    t = spark.createDataFrame([("a", "s"), ("b", "a"), ("b", "b"), ("c", "bad"), ("c", "s"), ("d", "gone")], "caller string, callee string")
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "funcname string")
    got = dict(propagate.beliefs(t, one("s"), one("bad"), one("a", "b", "c", "d"), one("a", "b", "c", "d", "s")).collect())
    assert got == {"s": 1, "a": 1, "b": 1, "c": -1, "d": -1}


_FACTS = "func string, seq int, kind string, lhs string, rhs string, callee string, args array<struct<idx:int,is_ptr:boolean,name:string>>"


def test_forward_taint(spark):
    s = spark.createDataFrame([
        ("f", 1, "decl", "p", None, "malloc", []), ("f", 2, "assign", "q", "p", None, []), ("f", 3, "assign", "x->m", "q", None, []), ("f", 4, "return", None, "q", None, []),
        ("g", 1, "return", None, None, "malloc", []),
    ], _FACTS)
    t = spark.createDataFrame([("f", "malloc"), ("g", "malloc")], "caller string, callee string")
    got = {r["caller"]: (r["passed_params"], r["return_values"], r["direct_return"]) for r in dataflow.forward_taint(s, t).collect()}
    assert got == {"f": (["p", "q", "x->m"], ["q"], 0), "g": ([], [], 1)}


def test_free_summaries(spark):
    arg = lambda n: [(0, True, n)]
    s = spark.createDataFrame([
        ("drop", 1, "assign", "q", "p", None, []), ("drop", 2, "call", None, None, "free", arg("q")),
        ("drop_all", 1, "call", None, None, "free", arg("box->item")), ("drop_all", 2, "call", None, None, "drop", arg("box")),
        ("outer", 1, "call", None, None, "drop_all", arg("b->inner")),
    ], _FACTS)
    protos = spark.createDataFrame([("drop", "char *@p,"), ("drop_all", "struct box *@box,"), ("outer", "struct b *@b,")], "funcname string, params string")
    seeds = spark.createDataFrame([("free", 0)], "funcname string, arg_index int")
    cand = protos.select("funcname")
    got = {r["funcname"]: ([tuple(p) for p in r["params"]], [tuple(m) for m in r["members"]]) for r in propagate.free_summaries(s, protos, seeds, cand).collect()}
    assert got["drop"] == ([(0, "p")], [])
    assert got["drop_all"] == ([(0, "box")], [(0, "box->item")])
    assert got["outer"] == ([], [(0, "b->inner"), (0, "b->inner->item")])
    again = spark.createDataFrame([("walk", 1, "call", None, None, "walk", arg("n->next")), ("walk", 2, "call", None, None, "free", arg("n"))], _FACTS)
    one = propagate.free_summaries(again, spark.createDataFrame([("walk", "struct n *@n,")], "funcname string, params string"), seeds, spark.createDataFrame([("walk",)], "funcname string"), 3).first()
    assert [tuple(m) for m in one["members"]] == [(0, "n->next"), (0, "n->next->next")]  # bounded, else it grows for ever


def test_null_resets(spark):
    s = spark.createDataFrame([("f", 1, "assign", "p", "x", None, []), ("f", 2, "call", None, None, "put", [(0, True, "p"), (1, False, "n")]), ("f", 3, "assign", "p", "NULL", None, []), ("f", 4, "assign", "n", "NULL", None, [])], _FACTS)
    assert names(dataflow.null_resets(s, spark.createDataFrame([("put",)], "funcname string")), "funcname", "arg_index") == [("put", 0)]


_EVENTS = [(1, "a", 1, "alloc"), (1, "a", 2, "use"), (1, "a", 3, "free"), (1, "a", 4, "use"), (1, "a", 5, "free"), (1, "a", 6, "alloc"), (1, "a", 7, "use"), (2, "a", 1, "free"), (2, "a", 2, "free")]
_WANT = [(1, "a", 4, "use_after_free"), (1, "a", 5, "double_free"), (2, "a", 2, "double_free")]


def test_memory_bugs(spark):
    e = spark.createDataFrame(_EVENTS, "path_id long, sym string, seq long, op string")
    assert names(ordering.memory_bugs(e), "path_id", "sym", "seq", "bug") == _WANT
    customised = e.withColumn("customised", F.col("path_id") == 2)
    assert names(ordering.memory_bugs(customised), "path_id") == [1, 1]


def test_streamed_bugs(spark, tmp_path):
    for k in range(0, len(_EVENTS), 3):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("path_id", "sym", "seq", "op"), x, strict=True))) for x in _EVENTS[k : k + 3]))
    s = streams.log_stream(spark, str(tmp_path), "path_id long, sym string, seq long, op string", per_trigger=100)
    q = streams.symbol_bugs(s).writeStream.format("memory").queryName("bugs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert names(spark.table("bugs"), "path_id", "sym", "seq", "bug") == _WANT


def test_stream_visits_and_compaction(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"caller":"a","pos":1,"callee":"x","number":1}\n{"caller":"a","pos":2,"callee":"x","number":5}\n{"caller":"a","pos":2,"callee":"y","number":1}')
    s = streams.log_stream(spark, str(tmp_path / "in"), "caller string, pos long, nth int, callee string, number int", per_trigger=1)
    for batch in ([("b", 3, 0, "z", None)], [("a", 2, 2, "y", 1)], [("a", 4, 0, "p", 1)], [("b", 3, 1, "z", 1)]):
        (tmp_path / f"in/b{batch[0][1]}{batch[0][2]}.json").write_text("\n".join(json.dumps(dict(zip(("caller", "pos", "nth", "callee", "number"), x, strict=True))) for x in batch))
    q = streams.compacting_writer(s, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4).start()
    q.processAllAvailable()
    q.stop()
    assert names(streams.compacted_table(spark, str(tmp_path / "out"), 4), "caller", "callee", "number") == [("a", "x", 5), ("a", "y", 2), ("b", "z", 2)]
    assert sorted(p.name for p in (tmp_path / "out/manifest").iterdir() if not p.name.startswith(".")) == ["3", "4"]
    v = streams.first_visits(s.withColumnRenamed("caller", "funcname")).writeStream.format("memory").queryName("visits").start()
    v.processAllAvailable()
    v.stop()
    assert names(spark.table("visits"), "funcname") == ["a", "b"]


@pytest.mark.parametrize("partitions", [4, 40, 200])
def test_renumbered_keeps_all_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(700_000)).alias("k"), F.lit("x" * 20).alias("wide"))
        got = ordering.renumbered(rows, "k")
        n = F.col("number")
        out = got.agg(F.count("*"), F.countDistinct(n), F.min(n), F.max(n), F.corr("k", n)).first()
        assert tuple(out)[:4] == (1_000_000, 1_000_000, 1, 1_000_000)
        swaps = got.alias("a").join(got.select((n - 1).alias("number"), F.col("k").alias("next")), "number").where("next < k").count()
        assert swaps == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_of_calls(spark):
    e = spark.createDataFrame([("a", 1, 0, "x", 5), ("a", 1, 1, "x", 2), ("a", 1, 2, "y", None), ("b", 2, 0, "x", None), ("b", 2, 1, "x", None)], "caller string, pos long, nth int, callee string, number int")
    assert names(summaries.calls_by_name(e), "caller", "callee", "number") == [("a", "x", 6), ("a", "y", 1), ("b", "x", 2)]


def test_tokens_of_prototypes_of_one_name(spark):
    p = spark.createDataFrame([("f", "int", "int@aa,"), ("f", "int", "char *@bb,int@aa,"), ("f", "int", "int@aa,")], "funcname string, return_type string, params string")
    got = names(analysis.tokens_of(p, {"f": 1.0, "aa": 1.0, "bb": 1.0}), F.array_join("tokens", " "))
    assert got == ["<cls> <noptr> f ( <noptr> aa )", "<cls> <noptr> f ( <ptr> bb <dot> <noptr> aa )"]


def test_shared_folder_is_asked_for(spark):
    from lapwing import staging

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "/shared"
    assert staging.shared_dir(Session) == "/shared"


def test_report(spark):
    html = "<table><tr><td href=\"x#reportHash=aa\">1</td></tr><tr><td href=\"y#reportHash=bb\">2</td></tr><tr><td href=\"z#reportHash=aa\">3</td></tr></table>"
    got = ordering.cleaned_report(spark.createDataFrame([(html,)], "html string"))
    assert names(got, "number", "report_hash") == [(1, "aa"), (2, "bb")]


def test_vectors(spark):
    e = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "k string, v array<float>")
    c = centroids(e.where("k <> 'z'"), "k", "v").first()[0]
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(c, [0.3, 0.9], strict=True))
    assert e.where("k = 'z'").select(l2_normalise(F.col("v"))).first()[0] == [0.0, 0.0]


def test_sampling_is_stable(spark):
    rows = spark.range(1000).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    one = names(sampling.labelled_pairs(rows.limit(5), rows, rows, 7), "anchor", "other", "y")
    assert one == names(sampling.labelled_pairs(rows.limit(5).repartition(3), rows.repartition(5), rows, 7), "anchor", "other", "y")
    assert len(one) == 70 and len(set(one)) == 70
    kept, held = sampling.equal_holdout(rows.withColumn("s", F.length("name")), "s", 4, "name")
    assert held.count() == 12 and kept.count() == 988


def test_models(spark):
    assert "hashed" in analysis.list_models()
    e = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    v = analysis.embed(e).first()["vector"]
    assert len(v) == 128 and math.isclose(sum(x * x for x in v), 1)


def test_variants_and_batches(spark):
    counts = {"ab": 5.0, "a": 2.0, "b": 2.0, "n": 1.0}
    protos = analysis.raw_prototypes(spark.createDataFrame([("void *ab(int n)",)], "value string"))
    got = {r["variant"]: r["tokens"] for r in analysis.token_variants(protos, counts, 2).collect()}
    assert got[0] == "<cls> <ptr> ab ( <noptr> n )".split() and got[1] == "<cls> <ptr> a b ( <noptr> n )".split()
    assert [len(b) for b in analysis.training_batches(spark.range(7), 3)] == [3, 3, 1]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("n", [(0, "p")], []), ("c", [(1, "p")], [(0, "a->b")])], "funcname string, params array<struct<idx:int,name:string>>, members array<struct<idx:int,name:string>>")
    files.write_summaries(s, str(tmp_path / "n"), str(tmp_path / "c"))
    assert names(files.plain_names(spark, str(tmp_path / "n")), "funcname") == ["n"]
    assert spark.read.json(str(tmp_path / "c")).first()["member_name"] == ["a->b"]
    files.write_similarity(spark.createDataFrame([("x", 0.1), ("y", 0.9)], "funcname string, cos double"), str(tmp_path / "s"))
    assert names(files.read_similarity(spark, str(tmp_path / "s")), "funcname", "cos") == [("x", 0.1), ("y", 0.9)]
    files.write_report(spark.createDataFrame([(2, "<tr>b</tr>"), (1, "<tr>a</tr>")], "number int, row_html string"), str(tmp_path / "r"))
    assert names(spark.read.text(str(tmp_path / "r")), "value") == ['<tr data-number="1">a</tr>', '<tr data-number="2">b</tr>']


def test_analysis_stages(spark):
    f = spark.createDataFrame([("my_alloc", "void *", "int@n,", "a.c"), ("my_free", "void", "void *@p,", "a.c")], "funcname string, return_type string, params string, file string")
    e = spark.createDataFrame([("my_alloc", 0, 0, "kmalloc", "void *", "int@n,", 1), ("my_free", 1, 0, "kfree", "void", "void *@p,", 1)], "caller string, pos long, nth int, callee string, return_type string, params string, number int")
    sim = spark.createDataFrame([("my_alloc", 0.9), ("kmalloc", 0.99)], "funcname string, cos double")
    official = spark.createDataFrame([("kmalloc",)], "funcname string")
    flows = spark.createDataFrame([(0, "my_alloc", "kmalloc", ["<nops>"], ["<nops>"], 1)], "pos long, caller string, callee string, passed_params array<string>, return_values array<string>, direct_return int")
    got = analysis.allocation_stage(f, e, sim, official, flows)
    assert names(got, "funcname") == ["kmalloc", "my_alloc"]
    s = spark.createDataFrame([("my_free", 1, "call", None, None, "kfree", [(0, True, "p")])], _FACTS)
    seeds = spark.createDataFrame([("kfree", 0)], "funcname string, arg_index int")
    freed = spark.createDataFrame([("my_free", 0.9), ("kfree", 0.99)], "funcname string, cos double")
    normal, customised = analysis.free_stage(f, e, freed, seeds, s)
    assert names(normal, "funcname") == ["kfree", "my_free"] and customised.count() == 0
