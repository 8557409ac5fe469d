"""Data flow, summaries, text formats and sampling on the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions import prototypes as P
from lapwing.functions import vectors
from lapwing.operators import dataflow, lookups, sampling, selection, sets, summaries
from lapwing.plans import analysis, propagate
from lapwing.queries import _DAG, _WITH, _from_orders, calls, edges, functions, query, sim, t
from lapwing.sources import files
from lapwing.staging import written_at

# data flow: the lines of an order are a function's assignments, each from the one before

_LINES = "SELECT l_orderkey AS func, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_quantity > 40 AS cut FROM lineitem"
_ARG = "array<struct<idx:int,is_ptr:boolean,name:string>>"


def _lines(spark, d) -> DataFrame:
    return spark.sql(_LINES.replace("FROM lineitem", "FROM {line}"), line=t(spark, d, "lineitem")).withColumn("func", F.col("func").cast("string"))


def _chain(spark, d, first: str) -> DataFrame:
    """v1 = first, v2 = v1, ... where a line that is cut takes another value."""
    rhs = F.when(F.col("cut"), F.lit("other")).when(F.col("r") == 1, F.lit(first)).otherwise(F.concat(F.lit("v"), (F.col("r") - 1).cast("string")))
    return _lines(spark, d).select("func", F.col("r").alias("seq"), F.lit("assign").alias("kind"), F.concat(F.lit("v"), F.col("r").cast("string")).alias("lhs"), rhs.alias("rhs"), F.lit(None).cast("string").alias("callee"), F.array().cast(_ARG).alias("args"))


@query(f"""WITH l AS ({_LINES}), m AS (SELECT func, max(r) AS m, min(CASE WHEN cut AND r > 1 THEN r END) AS b FROM l GROUP BY 1)
SELECT CAST(func AS STRING) AS caller, coalesce(b - 1, m) AS n_passed, CASE WHEN func % 3 = 0 THEN '' ELSE 'v' || CAST(m AS STRING) END AS returned, CASE WHEN func % 3 = 0 THEN 1 ELSE 0 END AS direct FROM m""")  # fmt: skip
def taint_chains(spark, d):
    """v1 takes malloc's result, each line hands it on; every third function returns the call itself."""
    chain = _chain(spark, d, "x")
    body = chain.withColumn("callee", F.when(F.col("seq") == 1, "malloc")).withColumn("rhs", F.when(F.col("seq") > 1, F.col("rhs")))
    last = chain.groupBy("func").agg(F.max("seq").alias("m"))
    direct = F.col("func").cast("long") % 3 == 0
    ends = last.select("func", (F.col("m") + 1).alias("seq"), F.lit("return").alias("kind"), F.lit(None).cast("string").alias("lhs"), F.when(~direct, F.concat(F.lit("v"), F.col("m").cast("string"))).alias("rhs"), F.when(direct, "malloc").alias("callee"), F.array().cast(_ARG).alias("args"))
    found = dataflow.forward_taint(body.unionByName(ends), last.select(F.col("func").alias("caller"), F.lit("malloc").alias("callee")))
    return found.select("caller", F.size("passed_params").cast("long").alias("n_passed"), F.array_join("return_values", ",").alias("returned"), F.col("direct_return").alias("direct"))


def _freeing(spark, d) -> DataFrame:
    chain = _chain(spark, d, "p0")
    last = chain.groupBy("func").agg(F.max("seq").alias("m"))
    arg = F.array(F.struct(F.lit(0).alias("idx"), F.lit(True).alias("is_ptr"), F.concat(F.lit("v"), F.col("m").cast("string")).alias("name")))
    none = F.lit(None).cast("string")
    return chain.unionByName(last.select("func", (F.col("m") + 1).alias("seq"), F.lit("call").alias("kind"), none.alias("lhs"), none.alias("rhs"), F.lit("free").alias("callee"), arg.alias("args")))


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([("free", 0)], "funcname string, arg_index int")


_CUTS = f"WITH l AS ({_LINES}), m AS (SELECT func, max(r) AS m, max(CASE WHEN cut THEN r END) AS b FROM l GROUP BY 1)"


@query(_CUTS + " SELECT CAST(func AS STRING) AS func, m - coalesce(b, 1) + 2 AS n_names FROM m")
def freed_aliases(spark, d):
    """The last line's value is freed: it and what it is an alias of."""
    s = _freeing(spark, d)
    return dataflow.backward_aliases(s, dataflow.freed_arguments(s, _seeds(spark))).select("func", F.size("names").cast("long").alias("n_names"))


@query(_CUTS + " SELECT CAST(func AS STRING) AS funcname, 'p0' AS name, 0 AS n_members FROM m WHERE b IS NULL")
def freed_parameters(spark, d):
    """Functions whose freed value comes from their parameter."""
    s = _freeing(spark, d)
    names = dataflow.backward_aliases(s, dataflow.freed_arguments(s, _seeds(spark)))
    protos = s.select(F.col("func").alias("funcname")).distinct().withColumn("params", F.lit("void *@p0,"))
    return dataflow.consistent(names, protos).select("funcname", F.get("params", F.lit(0))["name"].alias("name"), F.size("members").alias("n_members"))


@query(f"""WITH RECURSIVE e AS ({_DAG}), r AS (SELECT DISTINCT callee AS f FROM e WHERE callee % 16 = 7 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.f)
SELECT CAST(f AS STRING) AS funcname, 0 AS idx, 'p' AS name FROM r WHERE f IN (SELECT caller FROM e WHERE callee IN (SELECT f FROM r))""")  # fmt: skip
def freeing_wrappers(spark, d):
    """Functions that hand their parameter to one that frees it, through all layers."""
    e = _from_orders(spark, d, _DAG).selectExpr("CAST(caller AS STRING) AS caller", "callee")
    arg = F.array(F.struct(F.lit(0).alias("idx"), F.lit(True).alias("is_ptr"), F.lit("p").alias("name")))
    none = F.lit(None).cast("string")
    s = e.select(F.col("caller").alias("func"), F.col("callee").alias("seq"), F.lit("call").alias("kind"), none.alias("lhs"), none.alias("rhs"), F.col("callee").cast("string").alias("callee"), arg.alias("args"))
    names = e.select(F.col("caller").alias("funcname")).distinct()
    seeds = e.where("callee % 16 = 7").select(F.col("callee").cast("string").alias("funcname"), F.lit(0).alias("arg_index")).distinct()
    found = propagate.free_summaries(s, names.withColumn("params", F.lit("void *@p,")), seeds, names)
    return found.select("funcname", F.explode("params").alias("p")).select("funcname", "p.idx", "p.name")


@query("""SELECT CAST(l_orderkey AS STRING) AS func, min(l_linenumber * 1000000 + l_partkey) AS seq FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1""")
def first_target_calls(spark, d):
    line = t(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS func", "l_linenumber * 1000000 + l_partkey AS seq", "l_partkey AS callee")
    targets = line.where("callee % 5 = 0").select(F.col("callee").alias("funcname")).distinct()
    return dataflow.first_target_call(line, targets).select("func", "seq")


# flows of allocators: one for each part

_FLOW = """SELECT *, CASE p % 3 WHEN 0 THEN ['x', '<nops>'] WHEN 1 THEN ['dev->q', '<nops>'] ELSE ['n.m', 'y', '<nops>'] END AS passed,
CASE p % 7 WHEN 0 THEN ['x', '<nops>'] WHEN 1 THEN ['dev', '<nops>'] WHEN 2 THEN ['y', '<nops>'] ELSE ['<nops>'] END AS returned, CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END AS direct,
regexp_extract_all(params, '@([^,]*),', 1) AS args FROM (SELECT funcname, params, pos AS p FROM functions)"""
_GOOD = _WITH + f""", f AS ({_FLOW}), g AS (SELECT *, list_filter(passed, lambda x: x <> '<nops>' AND NOT list_has_any(list_filter(returned, lambda y: y <> '<nops>'), args) AND list_contains(args, regexp_extract(x, '^&?([^-.\\[]*)', 1))) AS escapes,
list_has_any(list_filter(passed, lambda x: x <> '<nops>'), returned) AS kept FROM f), h AS (SELECT funcname, direct = 1 OR (kept AND len(escapes) = 0) AS good, CAST(len(escapes) AS INT) AS n FROM g)"""


def _flows(spark, d) -> DataFrame:
    f = functions(spark, d)
    passed = F.expr("CASE pos % 3 WHEN 0 THEN array('x', '<nops>') WHEN 1 THEN array('dev->q', '<nops>') ELSE array('n.m', 'y', '<nops>') END")
    returned = F.expr("CASE pos % 7 WHEN 0 THEN array('x', '<nops>') WHEN 1 THEN array('dev', '<nops>') WHEN 2 THEN array('y', '<nops>') ELSE array('<nops>') END")
    return f.select("pos", F.col("funcname").alias("caller"), F.lit("malloc").alias("callee"), passed.alias("passed_params"), returned.alias("return_values"), F.expr("CASE WHEN pos % 11 = 0 THEN 1 ELSE 0 END").alias("direct_return"))


@query(_GOOD + " SELECT funcname FROM h WHERE good")
def believed_callers(spark, d):
    return dataflow.belief_flows(_flows(spark, d), functions(spark, d))[0]


@query(_GOOD + " SELECT funcname, CASE WHEN good THEN 1 ELSE 0 END AS n_returned, CASE WHEN good THEN 0 ELSE n END AS n_params FROM h WHERE good OR n > 0")
def alloc_summaries(spark, d):
    good, escapes = dataflow.belief_flows(_flows(spark, d), functions(spark, d))
    return dataflow.alloc_summaries(good, escapes).select("funcname", F.size("returned_object").alias("n_returned"), F.size("param_object").alias("n_params"))


@query(_GOOD + " SELECT CASE WHEN good THEN 'return' ELSE 'param' END AS bucket, count(*) AS n FROM h WHERE good OR n > 0 GROUP BY 1")
def alloc_class_counts(spark, d):
    good, escapes = dataflow.belief_flows(_flows(spark, d), functions(spark, d))
    return summaries.alloc_classes(dataflow.alloc_summaries(good, escapes))


@query(_WITH + f", f AS ({_FLOW}) SELECT funcname AS caller FROM f WHERE len(passed) > 1 OR len(returned) > 1 OR direct <> 0")
def flows_that_carry(spark, d):
    flows = _flows(spark, d)
    return summaries.distinct_flows(flows.unionByName(flows)).select("caller")


@query(_WITH + " SELECT funcname AS caller, 'malloc' AS callee FROM functions WHERE pos % 2 = 0")
def flows_of_targets(spark, d):
    targets = functions(spark, d).where("pos % 2 = 0").select(F.col("funcname").alias("caller"), F.lit("malloc").alias("callee"))
    return lookups.believed_flows(_flows(spark, d), targets.union(targets)).select("caller", "callee")


# summaries of deallocators

def _pairs(spark, d, names: str = "sequence(pos % 3, pos % 3)") -> DataFrame:
    pairs = F.expr(f"transform({names}, i -> struct(CAST(i AS INT) AS idx, concat('p', CAST(i AS STRING)) AS name))")
    empty = F.expr("CAST(array() AS array<struct<idx:int,name:string>>)")
    return functions(spark, d).select("funcname", "pos", pairs.alias("params"), F.when(F.col("pos") % 5 == 0, pairs).otherwise(empty).alias("members"))


@query(_WITH + " SELECT funcname, CAST(pos % 3 AS INT) AS idx FROM functions WHERE pos % 5 <> 0 UNION ALL SELECT 'kfree', 0")
def usable_deallocators(spark, d):
    return summaries.usable_directly(_pairs(spark, d), spark.createDataFrame([("kfree", 0)], "funcname string, arg_index int")).select("funcname", "idx")


@query(_WITH + " SELECT funcname, CAST(CASE WHEN pos % 3 = (pos + 1) % 2 THEN 1 ELSE 2 END AS BIGINT) AS n, 'p' || CAST((pos + 1) % 2 AS STRING) AS first FROM functions")
def merged_flow_pairs(spark, d):
    old, new = _pairs(spark, d), _pairs(spark, d, "sequence((pos + 1) % 2, (pos + 1) % 2)")
    return lookups.merged_pairs(old, new, "params").select("funcname", F.size("params").cast("long").alias("n"), F.get("params", F.lit(0))["name"].alias("first"))


_FREED = "SELECT concat('f', CAST(l_suppkey AS STRING)) AS funcname, CAST(count(*) AS BIGINT) AS n_calls FROM lineitem GROUP BY 1"
_PRIMITIVE = _WITH + f", k AS ({_FREED}), w AS (SELECT DISTINCT caller FROM edges WHERE callee IN (SELECT funcname FROM k JOIN sim USING (funcname) WHERE n_calls > 50 AND cos >= 0.9)), p AS (SELECT * FROM k WHERE funcname NOT IN (SELECT caller FROM w))"


def _called(spark, d) -> DataFrame:
    return edges(spark, d).groupBy(F.col("caller").alias("funcname")).agg(F.count("*").alias("n_calls"))


@query(_PRIMITIVE + " SELECT funcname, n_calls FROM p")
def primitive_deallocators(spark, d):
    return summaries.primitive_deallocators(_called(spark, d), edges(spark, d), sim(spark, d), 50, 0.9)


_CHECKED = "c AS (SELECT funcname, 0 AS arg_index, n_calls // 4 AS n FROM k WHERE n_calls % 3 = 0), z AS (SELECT CAST(floor(5 / min(n / n_calls)) AS BIGINT) AS cut FROM (SELECT * FROM c JOIN k USING (funcname) ORDER BY n DESC, funcname LIMIT 10))"


@query(_WITH + f", k AS ({_FREED}), {_CHECKED} SELECT cut, 'calls' AS unit FROM z")
def belief_cut(spark, d):
    k = _called(spark, d)
    checks = k.where("n_calls % 3 = 0").selectExpr("funcname", "0 AS arg_index", "n_calls div 4 AS n")
    return spark.createDataFrame([(summaries.belief_cut(checks, k, 5), "calls")], "cut long, unit string")


@query(_WITH + f", k AS ({_FREED}), {_CHECKED}, w AS (SELECT DISTINCT caller FROM edges WHERE callee IN (SELECT funcname FROM k JOIN sim USING (funcname) WHERE n_calls > 50 AND cos >= 0.5)), p AS (SELECT * FROM k WHERE funcname NOT IN (SELECT caller FROM w)) SELECT funcname, n_calls, coalesce(n >= 5 AND n_calls > cut, false) AS seed FROM p LEFT JOIN c USING (funcname), z WHERE n_calls <= cut OR n >= 5")
def primitive_seeds(spark, d):
    """Frequent deallocators that wrap no other, by the cut that the ten most reset ones give."""
    k = _called(spark, d)
    checks = k.where("n_calls % 3 = 0").selectExpr("funcname", "0 AS arg_index", "n_calls div 4 AS n")
    left, seeds = summaries.primitive_seeds(k, checks, edges(spark, d), sim(spark, d), 50, 5)
    return left.join(seeds.select("funcname", F.lit(True).alias("seed")), "funcname", "left").select("funcname", "n_calls", F.coalesce("seed", F.lit(False)).alias("seed"))


@query(_WITH + " SELECT funcname, CASE WHEN pos % 3 = 0 THEN 'normal' ELSE 'custom' END AS side, pos % 3 AS arg FROM functions WHERE pos % 4 = 0 UNION ALL SELECT funcname, 'normal', 0 FROM functions WHERE pos % 4 = 1")
def seeds_added(spark, d):
    f = functions(spark, d)
    half = f.where("pos % 8 = 0"), f.where("pos % 8 = 4")
    seeds = sets.seed_deallocators(*(x.select("funcname", (F.col("pos") % 3).cast("int").alias("arg_index")) for x in half))
    empty = _pairs(spark, d).where("false").select("funcname", "params", "members")
    normal, custom = sets.add_primitives(f.where("pos % 4 = 1").select("funcname"), empty, seeds)
    return normal.select("funcname", F.lit("normal").alias("side"), F.lit(0).cast("long").alias("arg")).unionByName(custom.select("funcname", F.lit("custom").alias("side"), F.get("params", F.lit(0))["idx"].cast("long").alias("arg")))


@query(_WITH + " SELECT funcname, CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END AS belief FROM functions")
def belief_bitmap(spark, d):
    f = functions(spark, d)
    return propagate.belief_bitmap(f, f.where("pos % 6 = 0"))


# names and prototypes

@query(_WITH + """ SELECT funcname, 'dropped' AS side FROM (SELECT CASE pos % 5 WHEN 0 THEN 'unregister_' WHEN 1 THEN 'my_remove' WHEN 2 THEN 'cleanupx' WHEN 3 THEN 'Unpin' ELSE 'un_pin' END AS funcname, pos FROM functions) WHERE pos % 5 < 3 GROUP BY ALL
UNION ALL SELECT funcname, 'kept' FROM (SELECT DISTINCT CASE pos % 5 WHEN 3 THEN 'Unpin' ELSE 'un_pin' END AS funcname FROM functions WHERE pos % 5 > 2)""")  # fmt: skip
def excluded_names(spark, d):
    names = functions(spark, d).selectExpr("CASE pos % 5 WHEN 0 THEN 'unregister_' WHEN 1 THEN 'my_remove' WHEN 2 THEN 'cleanupx' WHEN 3 THEN 'Unpin' ELSE 'un_pin' END AS funcname").distinct()
    return names.select("funcname", F.when(selection.excluded_name(F.col("funcname")), "dropped").otherwise("kept").alias("side"))


@query("SELECT p_partkey, p_size % 3 = 0 AS container, p_size % 2 = 0 AS member, CAST(CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 3 THEN 2 ELSE 1 END AS INT) AS largest FROM part")
def expression_predicates(spark, d):
    p = t(spark, d, "part")
    names = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("x"), F.lit("__mptr"))).otherwise(F.array(F.lit("mptr")))
    e = F.when(F.col("p_size") % 4 == 0, "a->b").when(F.col("p_size") % 2 == 0, "a.b").otherwise("ab")
    values = F.expr("CASE p_size % 4 WHEN 0 THEN array(2, 2, 1) WHEN 3 THEN array(0, 1, 5) ELSE array(1, 4, 4) END")
    return p.select("p_partkey", P.is_container(names).alias("container"), P.is_member(e).alias("member"), P.argmax(values).alias("largest"))


@query(_WITH + """ SELECT funcname, json_extract_string(j, '$.return_type') AS return_type, json_extract_string(j, '$.params') AS params FROM (SELECT funcname, to_json({'return_type': lower(return_type), 'params': lower(params)}) AS j FROM functions)""")
def prototype_json(spark, d):
    j = functions(spark, d).select(P.prototype_json(F.upper("return_type"), F.col("funcname"), F.upper("params")).alias("j"))
    return j.select(F.from_json("j", "funcname string, return_type string, params string").alias("x")).select("x.*")


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'int' ELSE 'struct dev *' END AS return_type, CASE p_size % 3 WHEN 0 THEN 'void *@void,' WHEN 1 THEN 'struct list *@list,int@int,' ELSE '' END AS params, CASE p_size % 3 WHEN 1 THEN 'int' ELSE 'dev' END AS word FROM part")
def indirect_calls(spark, d):
    text = F.expr("concat(CASE p_size % 2 WHEN 0 THEN 'int' ELSE 'struct dev *' END, ' (*)(', CASE p_size % 3 WHEN 0 THEN 'void *' WHEN 1 THEN 'struct list *, int' ELSE '' END, ')')")
    word = F.expr("CASE p_size % 3 WHEN 1 THEN 'unsigned int' ELSE 'const struct dev **' END")
    return t(spark, d, "part").select("p_partkey", P.indirect_call(text).alias("c"), P.last_word(word).alias("word")).select("p_partkey", "c.return_type", "c.params", "word")


@query(_WITH + " SELECT funcname, pos % 3 = 0 AND params LIKE '%@n,%' AS returns FROM functions")
def returns_a_parameter(spark, d):
    r = F.when(F.col("pos") % 3 == 0, F.array(F.lit("n"), F.lit("q"))).otherwise(F.array(F.lit("q")))
    return functions(spark, d).select("funcname", P.returns_parameter(r, F.col("params")).alias("returns"))


@query(_WITH + " SELECT funcname, 'found' AS side FROM functions WHERE pos % 3 = 0 UNION ALL SELECT 'g' || CAST(pos AS STRING), 'missing' FROM functions WHERE pos % 3 = 0")
def found_prototypes(spark, d):
    f = functions(spark, d)
    names = f.where("pos % 3 = 0").select("funcname").union(f.where("pos % 3 = 0").select(F.concat(F.lit("g"), F.col("pos").cast("string"))))
    hit, miss = lookups.found_prototypes(names, f.select("funcname", "return_type", "params"))
    return hit.select("funcname", F.lit("found").alias("side")).union(miss.select("funcname", F.lit("missing")))


@query(_WITH + " SELECT funcname, cos FROM functions LEFT JOIN (SELECT * FROM sim WHERE cos > 0.5) USING (funcname)")
def functions_with_similarity(spark, d):
    return lookups.with_similarity(functions(spark, d), sim(spark, d).where("cos > 0.5"), "left").select("funcname", "cos")


@query(_WITH + " SELECT 'semi' AS flag, count(*) AS n FROM sim WHERE cos <= 0.5 UNION ALL SELECT 'hard', count(*) FROM sim WHERE cos >= 0.3")
def rows_by_flag(spark, d):
    rows = sim(spark, d).withColumns({"semi": F.col("cos") <= 0.5, "hard": F.col("cos") >= 0.3})
    semi, hard = selection.split_by_flags(rows, "semi", "hard")
    return semi.agg(F.count("*").alias("n")).select(F.lit("semi").alias("flag"), "n").union(hard.agg(F.count("*").alias("n")).select(F.lit("hard").alias("flag"), "n"))


# similarity by a model: counts of pointer kinds, which SQL can count too


def _kinds(batch: list[list[str]]) -> list[list[float]]:
    return [[float(tokens.count(k)) for k in ("<ptr>", "<dptr>", "<noptr>", "<dot>")] + [1.0] for tokens in batch]


analysis.register_model("kinds", _kinds)


@query(_WITH + """, k AS (SELECT funcname, return_type, list_transform(string_split(rtrim(params, ','), ','), lambda p: CASE WHEN p = '' THEN '' WHEN contains(p, '**') THEN 'd' WHEN contains(p, '*') THEN 'p' ELSE 'n' END) AS ks,
CASE WHEN contains(return_type, '**') THEN 'd' WHEN contains(return_type, '*') THEN 'p' ELSE 'n' END AS r FROM functions),
v AS (SELECT funcname, r, [len(list_filter(ks, lambda x: x = 'p')) + CAST(r = 'p' AS INT), len(list_filter(ks, lambda x: x = 'd')) + CAST(r = 'd' AS INT), len(list_filter(ks, lambda x: x = 'n')) + CAST(r = 'n' AS INT), greatest(0, len(list_filter(ks, lambda x: x <> '')) - 1), 1] AS v FROM k),
u AS (SELECT funcname, r, i, CAST(v[i] AS DOUBLE) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM v, range(1, 6) g(i)), c AS (SELECT i, avg(x) AS c FROM u WHERE r <> 'n' GROUP BY i)
SELECT funcname, round(sum(x * c), 6) AS cos FROM u JOIN c USING (i) GROUP BY 1""")  # fmt: skip
def similarity_by_kinds(spark, d):
    """Raw prototypes to cosines: parse, segment, embed by a registered model, score against the centroid."""
    lines = functions(spark, d).select(P.render(F.col("return_type"), F.col("funcname"), F.col("params")).alias("value"))
    protos = analysis.raw_prototypes(lines)
    return analysis.similarity_inference(protos, {"f": 1.0, "n": 1.0}, protos.where(F.col("return_type").contains("*")), "kinds").select("funcname", F.round("cos", 6).alias("cos"))


@query("""SELECT CAST(w.id AS INT) AS id, CASE WHEN id <= 3 THEN 'hot' WHEN id % 2 = 0 THEN 'known' ELSE 'zero' END AS kind, CAST(CASE WHEN id <= 3 THEN id WHEN id % 2 = 0 THEN 2 ELSE 0 END AS INT) AS at FROM (SELECT p_partkey + 1 AS id FROM part) w""")
def embedding_rows(spark, d):
    ids = t(spark, d, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"), (F.col("p_partkey") + 1).cast("int").alias("id"))
    known = ids.where("id % 2 = 0").select("word", F.array(*[F.lit(x) for x in (0.0, 0.5, 0.0, 0.0)]).alias("vector"))
    m = vectors.embedding_matrix(ids, known, 3, 4)
    top = F.array_max("vector")
    kind = F.when(top == 1.0, "hot").when(top == 0.5, "known").otherwise("zero")
    return m.select("id", kind.alias("kind"), F.when(top == 0, 0).otherwise(F.array_position("vector", top)).cast("int").alias("at"))


# text formats: written, read again


@query(_WITH + " SELECT funcname, cos FROM sim")
def similarity_file(spark, d):
    path = written_at(spark, "similarity")
    files.write_similarity(sim(spark, d), path)
    return files.read_similarity(spark, path).select("funcname", "cos")


def _graph_file(spark, d) -> str:
    path = written_at(spark, "call-graph")
    callee = F.struct("nth", F.lit("int").alias("return_type"), F.col("callee").alias("funcname"), F.lit("").alias("params"), "number")
    groups = edges(spark, d).groupBy("caller", "pos").agg(F.sort_array(F.collect_list(callee)).alias("c"))
    caller = F.struct(F.lit("void").alias("return_type"), F.col("caller").alias("funcname"), F.lit("").alias("params"), F.lit("a.c").alias("file"))
    files.write_call_graph(groups.select(caller.alias("caller"), F.transform("c", lambda x: x.dropFields("nth")).alias("callees")), path)
    return path


@query(_WITH + " SELECT caller, callee, number FROM edges")
def call_graph_file(spark, d):
    return files.edges(files.read_call_graph(spark, _graph_file(spark, d))).select("caller", "callee", "number")


@query(_WITH + " SELECT caller, callee, arg_min(number, nth * 1000 + number) AS number FROM edges GROUP BY caller, pos, callee")
def call_graph_first_callees(spark, d):
    """Of a group's equal callees the first line stays."""
    e = files.edges(files.read_call_graph(spark, _graph_file(spark, d)))
    return lookups.first_by_name(e, ["pos", "caller", "callee"], "nth").select("caller", "callee", "number")


@query(_WITH + " SELECT 'callers' AS kind, count(*) AS n FROM (SELECT DISTINCT caller, pos FROM edges) UNION ALL SELECT 'all', count(*) FROM (SELECT caller FROM edges UNION SELECT callee FROM edges)")
def prototypes_of_a_graph(spark, d):
    """Caller lines, and distinct names of all lines."""
    path = _graph_file(spark, d)
    every = lookups.last_by_name(files.read_prototypes(spark, path).select("funcname", "return_type", "pos"))
    return files.caller_count(spark, path).select(F.lit("callers").alias("kind"), "n").union(every.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n"))


@query("""WITH e AS (SELECT vec_id, CAST(vec_id % 40 AS STRING) AS name, embedding FROM embeddings) SELECT name, count(*) AS n, round(sum(abs(x)), 3) AS l1 FROM (SELECT name, CAST(unnest(arg_max(embedding, vec_id)) AS DOUBLE) AS x FROM e GROUP BY name) GROUP BY 1""")
def embedding_file(spark, d):
    """Vectors as text; of a name's, the last one counts."""
    path = written_at(spark, "embeddings")
    rows = t(spark, d, "embeddings").select("vec_id", F.concat((F.col("vec_id") % 40).cast("string"), F.lit("|"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    rows.repartitionByRange(1, "vec_id").sortWithinPartitions("vec_id").select("value").write.text(path)
    last = files.last_embeddings(files.read_embeddings(spark, path))
    return last.select("name", F.size("vector").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda z, x: z + F.abs(x)), 3).alias("l1"))


@query("SELECT p_name AS word, CAST(count(*) AS DOUBLE) AS count, round(log10(count(*) / (SELECT count(*) FROM part)), 6) AS logp FROM part GROUP BY 1")
def vocabulary_file(spark, d):
    path = written_at(spark, "vocabulary")
    words = t(spark, d, "part").groupBy(F.col("p_name").alias("word")).count()
    total = words.agg(F.sum("count").alias("count")).select(F.lit("<total>").alias("word"), "count")
    words.union(total).select(F.concat_ws("\t", "word", F.col("count").cast("string")).alias("value")).write.text(path)
    return files.read_vocabulary(spark, path).select("word", "count", F.round("logp", 6).alias("logp"))


@query(_WITH + " SELECT caller, count(*) AS n, CAST(sum(number % 2) AS BIGINT) AS direct FROM calls GROUP BY 1")
def alloc_flow_file(spark, d):
    path = written_at(spark, "alloc-flows")
    flow = calls(spark, d).select("caller", "callee", F.array(F.lit("<nops>")).alias("passed_params"), F.array(F.lit("<nops>")).alias("return_values"), (F.col("number") % 2).cast("int").alias("direct_return"))
    files.write_json_lines(flow, path)
    return files.flows_by_caller(files.read_alloc_flows(spark, path)).select("caller", F.size("flows").cast("long").alias("n"), F.aggregate("flows", F.lit(0).cast("long"), lambda z, x: z + x["direct_return"]).alias("direct"))


@query("SELECT o_custkey AS funcname, CAST(arg_max(o_orderkey % 3, o_orderkey) AS INT) AS arg_index, CAST(arg_max(o_orderkey % 50, o_orderkey) AS BIGINT) AS n FROM orders GROUP BY 1")
def reassignment_file(spark, d):
    """Lines of a name, an argument and a number: a name's last line counts; no file is no line."""
    path = written_at(spark, "reassignments")
    rows = t(spark, d, "orders").repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows.select(F.concat_ws(" ", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 50).cast("string")).alias("value")).write.text(path)
    both = files.read_reassignments(spark, path).union(files.read_reassignments(spark, f"{path}-missing"))
    return both.select(F.col("funcname").cast("long").alias("funcname"), "arg_index", "n")


@query(_WITH + " SELECT funcname, CAST(pos % 3 AS INT) AS arg_index FROM functions")
def seed_file(spark, d):
    path = written_at(spark, "seeds")
    functions(spark, d).select(F.concat_ws("   ", "funcname", (F.col("pos") % 3).cast("string")).alias("value")).write.text(path)
    return files.read_names(spark, path)


@query(_WITH + " SELECT funcname, CAST(pos % 3 AS INT) AS idx, pos % 5 = 0 AS member FROM functions")
def free_flow_file(spark, d):
    """Flat alternating lists of indices and names, with their end mark."""
    path = written_at(spark, "free-flows")
    flat = F.array((F.col("pos") % 3).cast("string"), F.lit("p"), F.lit("<nops>"))
    rows = functions(spark, d).select("funcname", flat.alias("param_names"), F.when(F.col("pos") % 5 == 0, flat).otherwise(F.array(F.lit("<nops>"))).alias("member_name"))
    files.write_json_lines(rows, path)
    return files.read_free_flows(spark, path).select("funcname", F.get("params", F.lit(0))["idx"].alias("idx"), (F.size("members") > 0).alias("member"))


# sampling


@query("SELECT target, positive, count(*) AS n FROM (SELECT 'alloc' AS target, p_size < 10 AS positive FROM part UNION ALL SELECT 'free', p_size BETWEEN 10 AND 19 FROM part) GROUP BY ALL")
def classes_for_training(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("name"), "p_size")
    return sampling.merged_classes(p.where("p_size < 10"), p.where("p_size BETWEEN 10 AND 19"), p.where("p_size > 19")).groupBy("target", "positive").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS anchor, 2 AS y_kinds, 3 AS n FROM customer WHERE c_custkey % 10 = 0")
def triplets(spark, d):
    """Three triplets for each anchor, of distinct positives and distinct negatives."""
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name"), "c_custkey")
    got = sampling.triplets(c.where("c_custkey % 10 = 0"), c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), 3)
    rows = got.groupBy(F.col("anchor").cast("long").alias("anchor")).agg(F.countDistinct("positive").alias("p"), F.countDistinct("negative").alias("q"), F.max(F.col("positive").cast("long") % 2).alias("odd"), F.min(F.col("negative").cast("long") % 2).alias("even"))
    return rows.select("anchor", F.when((F.col("odd") == 0) & (F.col("even") == 1), 2).otherwise(0).alias("y_kinds"), F.least("p", "q").cast("int").alias("n"))


@query("""WITH e AS (SELECT user_id AS anchor, CAST(count(DISTINCT event_id % 30) AS BIGINT) AS n, user_id % 2 = 0 AS twice FROM events GROUP BY 1)
SELECT anchor, least(n, CASE WHEN twice THEN 10 ELSE 5 END) AS positives, least(n, 5) AS hard FROM e""")  # fmt: skip
def resampled_training_pairs(spark, d):
    """Semi-hard anchors keep twice as many partners; hard negatives come on top."""
    e = t(spark, d, "events").select(F.col("user_id").alias("anchor"), (F.col("event_id") % 30).alias("other")).distinct()
    pairs = e.withColumns({"y": F.lit(1), "semi_hard": F.col("anchor") % 2 == 0})
    got = sampling.resampled_pairs(pairs, e, 5)
    return got.groupBy("anchor").agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == -1).alias("hard"))
