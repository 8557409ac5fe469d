"""The analysis operators on the driver's tables, each with equivalent SQL.

The tables stand in for a program: parts are functions (with a return type, parameters
and a similarity made from their columns), line items are calls, events are traces.
The column mappings are written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import prototypes as P
from lapwing.functions import segment, vectors
from lapwing.operators import dataflow, lookups, metrics, ordering, sampling, selection, sets, summaries
from lapwing.plans import analysis, propagate

#: Most words that a segmenter function takes along.
VOCABULARY = 500_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_FUNCTIONS = [
    "concat('f', CAST(p_partkey AS STRING)) AS funcname",
    "CASE p_size % 5 WHEN 0 THEN 'void *' WHEN 1 THEN 'struct dev *' WHEN 2 THEN 'void' WHEN 3 THEN 'int' ELSE 'char **' END AS return_type",
    "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'int@n,' WHEN 2 THEN 'struct dev *@dev,int@n,' ELSE 'void *@p,char **@names,' END AS params",
    "concat(p_brand, CASE WHEN p_size % 2 = 0 THEN '.c' ELSE '.h' END) AS file",
    "p_partkey AS pos",
]
_SIM = ["concat('f', CAST(p_partkey AS STRING)) AS funcname", "CAST((p_partkey * 37) % 1000 AS DOUBLE) / 1000 AS cos"]
_EDGES = ["concat('f', CAST(l_suppkey AS STRING)) AS caller", "l_orderkey AS pos", "concat('f', CAST(l_partkey AS STRING)) AS callee", "CAST(l_quantity AS INT) AS number", "l_linenumber AS nth"]
_TRACE = [
    "user_id AS path_id", "concat('s', CAST(event_id % 3 AS STRING)) AS sym", "event_id AS seq",
    "CASE event_type WHEN 'view' THEN 'use' WHEN 'click' THEN 'use' WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'free' ELSE 'other' END AS op",
]


def functions(spark, d):
    return t(spark, d, "part").selectExpr(*_FUNCTIONS)


def sim(spark, d):
    return t(spark, d, "part").selectExpr(*_SIM)


def edges(spark, d):
    return t(spark, d, "lineitem").selectExpr(*_EDGES)


def trace(spark, d):
    return t(spark, d, "events").selectExpr(*_TRACE)


_WITH = f"""WITH functions AS (SELECT {", ".join(_FUNCTIONS)} FROM part), sim AS (SELECT {", ".join(_SIM)} FROM part),
edges AS (SELECT {", ".join(_EDGES)} FROM lineitem), trace AS (SELECT {", ".join(_TRACE)} FROM events),
calls AS (SELECT caller, callee, CAST(sum(number) AS BIGINT) AS number FROM edges GROUP BY ALL)
"""
_KIND = "CASE WHEN contains({x}, '**') THEN '<dptr>' WHEN contains({x}, '*') THEN '<ptr>' ELSE '<noptr>' END"


def calls(spark, d):
    return edges(spark, d).groupBy("caller", "callee").agg(F.sum("number").alias("number"))


# scalars


@query(f"SELECT doc_id, {_KIND.format(x='text')} AS kind, CASE WHEN contains(text, '*') THEN '*' WHEN regexp_matches(text, 'int|bool|void') THEN '$' ELSE '#' END AS mark FROM documents")
def type_kinds(spark, d):
    return t(spark, d, "documents").select("doc_id", P.pointer_kind(F.col("text")).alias("kind"), P.pointer_mark(F.col("text")).alias("mark"))


@query(_WITH + "SELECT funcname, return_type, params FROM functions")
def prototype_round_trip(spark, d):
    shown = functions(spark, d).select(P.render(F.col("return_type"), F.col("funcname"), F.col("params")).alias("line"))
    return analysis.raw_prototypes(shown, "line").select("funcname", "return_type", "params")


@query(_WITH + "SELECT funcname, return_type, params FROM functions")
def piped_round_trip(spark, d):
    shown = functions(spark, d).select(P.piped(F.col("return_type"), F.col("funcname"), F.col("params")).alias("line"))
    return shown.select(P.parse_piped(F.col("line")).alias("r")).select("r.funcname", "r.return_type", "r.params")


@query(_WITH + """SELECT funcname, i - 1 AS idx, regexp_extract(p, '^(.*)@', 1) AS raw_type, regexp_extract(p, '@(.*)$', 1) AS name,
CASE WHEN contains(p, '**') THEN '<dptr>' WHEN contains(p, '*') THEN '<ptr>' ELSE '<noptr>' END AS kind
FROM (SELECT funcname, unnest(string_split(rtrim(params, ','), ',')) AS p, generate_subscripts(string_split(rtrim(params, ','), ','), 1) AS i FROM functions WHERE params <> '')""")  # fmt: skip
def parameters(spark, d):
    rows = functions(spark, d).select("funcname", F.posexplode(P.parse_params(F.col("params"))).alias("idx", "p"))
    return rows.select("funcname", F.col("idx").cast("long").alias("idx"), "p.raw_type", "p.name", "p.kind")


@query("SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z]', '', 'g') AS clean, CAST(p_size AS STRING) || '->a.b' AS expr, CAST(p_size AS STRING) AS base, '->a.b' AS member, CAST(p_size AS STRING) || '/a/b' AS path, 'new->a.b' AS renamed FROM part")
def member_names(spark, d):
    e = F.concat(F.col("p_size").cast("string"), F.lit("->a.b"))
    return t(spark, d, "part").select("p_partkey", P.clean(F.concat("p_name", "p_brand")).alias("clean"), e.alias("expr"), P.member_base(e).alias("base"), P.member_name(e).alias("member"), F.array_join(P.member_path(e), "/").alias("path"), P.change_base(e, F.lit("new")).alias("renamed"))


@query("""SELECT p_partkey, array_to_string([CASE WHEN i <= len(w) THEN len(w[i]) ELSE 0 END FOR i IN [1, 2, 3, 4, 5, 6]], ',') AS ids
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")  # fmt: skip
def padded_id_vectors(spark, d):
    ids = F.transform(F.split("p_name", " "), lambda w: F.length(w))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(P.padded_ids(ids, 6), lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH rows AS (SELECT p_partkey AS k, p_name FROM part UNION ALL SELECT p_partkey % 7, p_name FROM part UNION ALL SELECT p_partkey, '' FROM part),
v AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size > 5)),
n AS (SELECT DISTINCT p_name FROM part), i AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM n),
g AS (SELECT p_name, string_agg(CAST(coalesce(id, 0) AS STRING), ',' ORDER BY i) AS ids FROM i LEFT JOIN v USING (word) GROUP BY 1)
SELECT k, coalesce(ids, '') AS ids FROM rows LEFT JOIN g USING (p_name)""")  # fmt: skip
def word_id_vectors(spark, d):
    """Whole names, with repeated rows, empty lists, and words that the vocabulary lacks."""
    part = t(spark, d, "part").withColumn("w", F.split("p_name", " "))
    words = part.where("p_size > 5").select(F.explode("w").alias("word")).distinct()
    rows = part.select(F.col("p_partkey").alias("k"), "w").union(part.select(F.col("p_partkey") % 7, "w")).union(part.select("p_partkey", F.array().cast("array<string>")))
    found = segment.word_ids(rows, "w", ordering.renumbered(words, "word", name="id"))
    return found.select("k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def _part_words(spark, d) -> dict[str, float]:
    """Words of the part names with their counts: the names are drawn from a fixed list.
    The function form of the segmenter holds its vocabulary in memory; one beyond its
    bound is an error, and work for ``native_segments``."""
    rows = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").count().limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} words: use native_segments")
    return {r["w"]: float(r["count"]) for r in rows}


@query("SELECT p_partkey, p_name AS words FROM part")
def segmented_names(spark, d):
    cut = segment.segment_udf(_part_words(spark, d))
    names = t(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("name"))
    return names.select("p_partkey", F.array_join(cut("name"), " ").alias("words"))


@query("SELECT DISTINCT replace(p_name, ' ', '') AS name, p_name AS words FROM part")
def segmented_names_native(spark, d):
    words = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").count()
    total = words.agg(F.sum("count").alias("n"))
    logs = words.join(F.broadcast(total)).select("word", F.log10(F.col("count") / F.col("n")).alias("logp"))
    names = t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))
    return segment.native_segments(names, "name", logs).select("name", F.array_join("words", " ").alias("words"))


@query("SELECT p_partkey, least(12, length(p_name)) AS n, p_name[1:2] AS second FROM part")
def first_word_choices(spark, d):
    p = segment.prefixes(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", F.size(p).cast("long").alias("n"), F.get(p, F.lit(1))["prefix"].alias("second"))


# vectors

_VECTORS = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
l AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1), u AS (SELECT e.vec_id, label, i, x / n AS x FROM e JOIN l USING (vec_id)),
c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), g AS (SELECT i, avg(x) AS x FROM u WHERE label = 0 GROUP BY 1),
cos AS (SELECT vec_id, label, sum(u.x * g.x) AS cos FROM u JOIN g USING (i) GROUP BY ALL)
"""


@query(_VECTORS + "SELECT vec_id, round(sum(abs(x)), 4) AS l1 FROM u GROUP BY 1")
def l2_normalised(spark, d):
    v = vectors.l2_normalise(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda z, x: z + F.abs(x)), 4).alias("l1"))


@query(_VECTORS + "SELECT label, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM c")
def class_centroids(spark, d):
    c = vectors.centroids(t(spark, d, "embeddings"), "vec_id", "embedding", ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def _cosines(spark, d) -> DataFrame:
    e = t(spark, d, "embeddings")
    return vectors.scores(e, "vec_id", "embedding", vectors.centroids(e.where("label = 0"), "vec_id", "embedding"))


@query(_VECTORS + "SELECT vec_id, round(cos, 5) AS cos FROM cos")
def cosine_to_centroid(spark, d):
    return _cosines(spark, d).select("vec_id", F.round("cos", 5).alias("cos"))


@query(_VECTORS + """, m AS (SELECT count(*) FILTER (label = 0 AND cos > 0.15) AS tp, count(*) FILTER (label = 0 AND NOT cos > 0.15) AS fn,
count(*) FILTER (label <> 0 AND cos < 0.15) AS tn, count(*) FILTER (label <> 0 AND NOT cos < 0.15) AS fp FROM cos)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM m""")  # fmt: skip
def threshold_metrics(spark, d):
    rows = _cosines(spark, d).join(t(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).alias("positive")), "vec_id")
    m = metrics.threshold_metrics(rows, 0.15)
    return m.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_VECTORS + "SELECT vec_id, label = 0 AND cos <= 0.5 AS semi_hard_positive, label <> 0 AND cos >= 0.98 AS hardest, label <> 0 AND cos BETWEEN -0.8 AND 0.98 AS semi_hard_negative FROM cos")
def hard_masks(spark, d):
    rows = _cosines(spark, d).join(t(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return rows.select("vec_id", selection.hard_flags(F.col("cos"), F.col("label") == 0).alias("f")).select("vec_id", "f.*")


@query(_VECTORS + "SELECT label = 0 AS positive, round(avg(power(cos - CASE WHEN label = 0 THEN 1 ELSE -1 END, 2)), 5) AS squared, round(avg(CASE WHEN label = 0 THEN power(1 - cos, 2) ELSE power(greatest(cos, 0), 2) END), 5) AS contrastive FROM cos GROUP BY 1")
def pair_losses(spark, d):
    rows = _cosines(spark, d).join(t(spark, d, "embeddings").select("vec_id", "label"), "vec_id").withColumn("y", F.when(F.col("label") == 0, 1).otherwise(-1))
    losses = [F.round(F.avg(f(F.col("cos"), F.col("y"))), 5).alias(n) for f, n in ((vectors.squared_loss, "squared"), (vectors.contrastive_loss, "contrastive"))]
    return rows.groupBy((F.col("label") == 0).alias("positive")).agg(*losses)


@query("""WITH c AS (SELECT p_brand AS funcname, count(*) AS n FROM part GROUP BY 1) SELECT funcname, CASE WHEN n * 250 < 10000 THEN 2 WHEN n * 250 < 50000 THEN 5 WHEN n * 250 < 100000 THEN 10 ELSE 20 END AS least FROM c""")
def size_tiers(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("funcname")).agg(F.count("*").alias("n")).select("funcname", P.class_tiers(F.col("n") * 250).alias("least"))


@query("""SELECT o_custkey, max(i) AS place FROM (SELECT o_custkey, CASE WHEN o_orderkey = first THEN 0 ELSE 1 END AS i FROM (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)) GROUP BY 1""")
def overlap_split(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    inside, outside = lookups.split_overlap(o, first, "o_orderkey")
    both = inside.select("o_custkey", F.lit(0).alias("place")).union(outside.select("o_custkey", F.lit(1)))
    return both.groupBy("o_custkey").agg(F.max("place").alias("place"))


@query(_WITH + """, h AS (SELECT path_id, sym, count(*) FILTER (op = 'alloc') AS n_alloc, count(*) FILTER (op = 'free') AS n_free FROM trace GROUP BY ALL)
SELECT path_id, CAST(sum(n_alloc) AS BIGINT) AS n_alloc, CAST(sum(n_free) AS BIGINT) AS n_free FROM h GROUP BY 1""")  # fmt: skip
def path_counters(spark, d):
    return trace(spark, d).groupBy("path_id").agg(F.count_if(F.col("op") == "alloc").alias("n_alloc"), F.count_if(F.col("op") == "free").alias("n_free"))


@query()
def segment_variants(spark, d):
    """Three segmentations of each part name, best first."""
    names = t(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("name")).distinct()
    cut = segment.k_best_udf(_part_words(spark, d), 3)
    return names.select("name", F.posexplode(cut("name")).alias("variant", "w")).select("name", "variant", F.array_join("w", " ").alias("words"))


@query("""WITH f AS (SELECT DISTINCT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS class, doc_id FROM labels), l AS (SELECT DISTINCT CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS class, doc_id FROM labels),
j AS (SELECT coalesce(f.class, l.class) AS class, f.doc_id AS a, l.doc_id AS b FROM f FULL JOIN l ON f.class = l.class AND f.doc_id = l.doc_id)
SELECT class, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM j GROUP BY ROLLUP (class)""")  # fmt: skip
def class_metrics(spark, d):
    labels = t(spark, d, "labels")
    found = labels.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("class"), "doc_id")
    truth = labels.select(F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("class"), "doc_id")
    return metrics.class_metrics(found, truth, "doc_id").select("class", "tp", "fp", "fn")


@query("""SELECT count(*) FILTER (toxic > 0 AND f) AS tp, count(*) FILTER (toxic = 0 AND f) AS fp, count(*) FILTER (toxic = 0 AND NOT f) AS tn, count(*) FILTER (toxic > 0 AND NOT f) AS fn
FROM (SELECT l.toxic, d.doc_id IS NOT NULL AS f FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id))""")  # fmt: skip
def label_metrics(spark, d):
    found = t(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return metrics.label_metrics(found, t(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").select("tp", "fp", "tn", "fn")


# selection

_PTR = "contains(params, '*')"


@query(_WITH + f"SELECT funcname, cos FROM functions JOIN sim USING (funcname) WHERE cos > 0.5 AND (contains(return_type, '*') OR {_PTR})")
def alloc_candidates(spark, d):
    return selection.alloc_candidates(functions(spark, d), sim(spark, d)).select("funcname", "cos")


@query(_WITH + """SELECT funcname, cos, n AS n_alloc_calls FROM functions JOIN sim USING (funcname)
JOIN (SELECT caller AS funcname, CAST(sum(number) AS BIGINT) AS n FROM edges WHERE callee IN (SELECT funcname FROM sim WHERE cos >= 0.5) GROUP BY 1) USING (funcname)
WHERE cos > 0.6 AND contains(return_type, '*') AND NOT contains(return_type, '**') AND n >= 1 AND (NOT contains(return_type, 'struct') OR n = 1)""")  # fmt: skip
def special_allocators(spark, d):
    return selection.special_allocators(functions(spark, d), edges(spark, d), sim(spark, d), strong=0.6).select("funcname", "cos", "n_alloc_calls")


@query(_WITH + f"""SELECT funcname, n AS n_free_calls FROM functions JOIN sim USING (funcname)
JOIN (SELECT caller AS funcname, CAST(sum(number) AS BIGINT) AS n FROM edges WHERE callee IN (SELECT funcname FROM sim WHERE cos > 0.5) GROUP BY 1) USING (funcname)
WHERE cos > 0.5 AND NOT contains(return_type, '*') AND {_PTR} AND n >= 1 AND funcname NOT IN ('f1', 'f2', 'f3')""")  # fmt: skip
def free_candidates(spark, d):
    denied = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "funcname string")
    return selection.free_candidates(functions(spark, d), edges(spark, d), sim(spark, d), denied)[0].select("funcname", "n_free_calls")


_COUNTS = "SELECT funcname, 1 + coalesce(n, 0) AS n_calls FROM (SELECT DISTINCT funcname FROM functions WHERE NOT contains(return_type, '*')) LEFT JOIN (SELECT callee AS funcname, CAST(sum(number) AS BIGINT) AS n FROM edges GROUP BY 1) USING (funcname)"


@query(_WITH + _COUNTS)
def call_site_counts(spark, d):
    return selection.call_counts(functions(spark, d).where(~F.col("return_type").contains("*")), edges(spark, d)).select("funcname", "n_calls")


_RESET = "SELECT concat('f', CAST(l_suppkey AS STRING)) AS funcname, l_linenumber - 1 AS arg_index, count(*) AS n FROM lineitem GROUP BY ALL"


@query(_WITH + f""", counts AS ({_COUNTS}), checks AS (SELECT funcname, CAST(arg_index AS INT) AS arg_index, n FROM ({_RESET}) WHERE arg_index = 0)
SELECT funcname, arg_index, n, n_calls FROM functions JOIN sim USING (funcname) JOIN checks USING (funcname) JOIN counts USING (funcname)
JOIN (SELECT caller AS funcname, count(*) AS k FROM edges WHERE callee IN (SELECT funcname FROM sim WHERE cos > 0.998) GROUP BY 1) USING (funcname)
WHERE contains(return_type, 'void') AND cos > 0.01 AND n >= 2 AND k = 1 AND params <> '' AND NOT contains(split_part(params, '@', 1), 'struct') AND NOT (2 * n >= n_calls AND n < 12)""")  # fmt: skip
def special_deallocators(spark, d):
    counts = selection.call_counts(functions(spark, d).where(~F.col("return_type").contains("*")), edges(spark, d))
    line = t(spark, d, "lineitem")
    checks = line.where("l_linenumber = 1").groupBy(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("funcname")).agg(F.count("*").alias("n")).withColumn("arg_index", F.lit(0))
    found = edges(spark, d).withColumn("number", F.lit(1))
    # the callees' threshold is that of near-certain ones, so that a caller may have one
    return selection.special_deallocators(functions(spark, d), found, sim(spark, d), checks, counts, 2, 0.01, 0.998)


@query(_WITH + "SELECT funcname FROM functions WHERE file LIKE '%.c' AND funcname IN (SELECT caller FROM edges) AND funcname NOT IN (SELECT funcname FROM sim WHERE cos > 0.9)")
def chain_candidates(spark, d):
    belief = sim(spark, d).select("funcname", (F.col("cos") > 0.9).cast("int").alias("belief"))
    return selection.chain_candidates(selection.by_extension(functions(spark, d), ".c"), edges(spark, d), belief).select("funcname")


# joins


@query(_WITH + """, o AS (SELECT *, row_number() OVER (PARTITION BY caller, pos ORDER BY callee, number) AS nth FROM (SELECT caller, pos, CASE WHEN callee LIKE 'f%7' THEN 'malloc' ELSE callee END AS callee, CAST(sum(number) AS BIGINT) AS number FROM edges GROUP BY ALL)),
b AS (SELECT *, coalesce(max(CAST(callee = 'malloc' AS INT)) OVER (PARTITION BY caller, pos ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM o)
SELECT caller, b.pos, callee, number FROM b LEFT JOIN sim ON sim.funcname = callee LEFT JOIN functions f ON f.funcname = callee
WHERE after = 0 AND (callee = 'malloc' OR cos > 0.8 OR (cos >= 0.5 AND cos < 0.9 AND contains(f.return_type, '*')))""")  # fmt: skip
def target_callees(spark, d):
    from pyspark.sql import Window

    e = edges(spark, d).withColumn("callee", F.when(F.col("callee").like("f%7"), "malloc").otherwise(F.col("callee"))).groupBy("caller", "pos", "callee").agg(F.sum("number").alias("number"))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("caller", "pos").orderBy("callee", "number")))
    e = e.join(functions(spark, d).select(F.col("funcname").alias("callee"), "return_type"), "callee", "left")
    belief = sim(spark, d).where("cos < 0.9 OR cos > 0.8").select("funcname", (F.col("cos") > 0.8).cast("int").alias("belief"))
    return lookups.target_callees(e, belief, sim(spark, d)).select("caller", "pos", "callee", "number")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def last_wins(spark, d):
    return lookups.last_by_name(t(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_wins(spark, d):
    return lookups.first_by_name(t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_overlap(spark, d):
    return lookups.split_overlap(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")[0].select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_overlap(spark, d):
    return lookups.split_overlap(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")[1].select("doc_id", "lang")


@query("SELECT DISTINCT p_name AS funcname FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 49)")
def without_labelled(spark, d):
    part = t(spark, d, "part").select(F.col("p_name").alias("funcname"), "p_size")
    return lookups.without_labelled(part.select("funcname"), part.where("p_size > 49")).distinct()


@query("SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'old' ELSE 'new' END AS side FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'en') b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def symmetric_difference(spark, d):
    return lookups.symmetric_difference(t(spark, d, "labels"), t(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT c_custkey AS funcname FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND c_acctbal <= 5000")
def append_new(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "funcname")
    return lookups.append_new(c.where("c_acctbal > 5000").select("funcname"), c.where("c_nationkey < 5").select("funcname"))


@query(_WITH + "SELECT caller, callee, number FROM calls WHERE caller IN (SELECT funcname FROM sim WHERE cos > 0.7) AND callee IN (SELECT funcname FROM sim WHERE cos > 0.7)")
def summarised_edges(spark, d):
    return lookups.summarised_edges(calls(spark, d), sim(spark, d).where("cos > 0.7")).select("caller", "callee", "number")


@query(_WITH + "SELECT DISTINCT file FROM functions WHERE pos % 7 = 3")
def next_units(spark, d):
    f = functions(spark, d)
    db = f.select("file").distinct()
    return lookups.next_units(db, f, f.select("funcname", (F.col("pos") % 7).alias("depth")), 2)


@query(_WITH + """SELECT funcname, 'dev->' || CAST(pos % 3 AS STRING) AS name, CASE WHEN params LIKE 'struct dev%' THEN 0 WHEN params = 'int@n,' THEN 0 ELSE 99 END AS arg_index FROM functions""")
def argument_index(spark, d):
    f = functions(spark, d)
    rows = f.select("funcname", F.concat(F.lit("dev->"), (F.col("pos") % 3).cast("string")).alias("name"))
    return lookups.argument_index(rows, f)


@query(_WITH + "SELECT callee, CAST(sum(number) AS BIGINT) AS n, CASE WHEN callee IN (SELECT funcname FROM sim WHERE cos > 0.9) THEN 'alloc' WHEN callee IN (SELECT funcname FROM sim WHERE cos > 0.5) THEN 'free' WHEN callee IN (SELECT funcname FROM sim WHERE cos < 0.2) THEN 'realloc' END AS op FROM calls GROUP BY callee")
def call_summaries(spark, d):
    s = sim(spark, d)
    out = lookups.call_summaries(calls(spark, d), s.where("cos > 0.9"), s.where("cos > 0.5"), s.where("cos < 0.2"))
    return out.groupBy("callee", "op").agg(F.sum("number").alias("n")).select("callee", "n", "op")


@query(_WITH + "SELECT funcname FROM functions WHERE params = 'int@n,'")
def single_parameter(spark, d):
    f = functions(spark, d)
    return lookups.single_parameter(f.select("funcname"), f)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_nationkey < 5 THEN 'near' ELSE 'rest' END AS tag FROM customer")
def prioritised_union(spark, d):
    c = t(spark, d, "customer")
    parts = [c.where(w).select("c_custkey", F.lit(tag).alias("tag")) for w, tag in (("c_acctbal > 5000", "rich"), ("c_nationkey < 5", "near"), ("true", "rest"))]
    return lookups.prioritised(*parts, key="c_custkey")


# aggregations


_COUNTED = "SELECT pos, caller, callee, arg_min(number, nth * 1000 + number) + count(*) - 1 AS number FROM edges GROUP BY ALL"


@query(_WITH + _COUNTED)
def calls_by_name(spark, d):
    return summaries.calls_by_name(edges(spark, d))


@query(_WITH + "SELECT caller, arg_max(pos, n * 100000000 - pos) AS pos, max(n) AS n_callees FROM (SELECT caller, pos, count(DISTINCT callee) AS n FROM edges GROUP BY ALL) GROUP BY caller")
def best_groups(spark, d):
    e = edges(spark, d)
    return summaries.best_groups(e, e.select("caller", "pos").distinct())


_COMPACTED = f""", k AS ({_COUNTED}), b AS (SELECT caller, arg_max(pos, n * 100000000 - pos) AS pos FROM (SELECT caller, pos, count(*) AS n FROM k GROUP BY ALL) GROUP BY caller)
SELECT caller, callee, number FROM k JOIN b USING (caller, pos)"""


@query(_WITH + _COMPACTED)
def compacted_call_graph(spark, d):
    e = edges(spark, d)
    return summaries.compacted(e, e.select("caller", "pos").distinct())


@query(_WITH + _COMPACTED)
def compacted_twice(spark, d):
    """Compacting a compacted graph again changes nothing: the numbers stay."""
    e = edges(spark, d)
    once = summaries.compacted(e, e.select("caller", "pos").distinct()).withColumns({"pos": F.lit(0), "nth": F.lit(0)})
    return summaries.compacted(once, once.select("caller", "pos").distinct())


@query("""SELECT funcname, CAST(arg_max(i, c * 100 - i) AS INT) AS arg_index, CAST(max(c) AS BIGINT) AS n FROM
(SELECT funcname, CASE WHEN i < 7 THEN i ELSE 0 END AS i, CASE WHEN i < 7 THEN c ELSE 0 END AS c FROM (SELECT user_id AS funcname, event_id % 9 AS i, count(*) AS c FROM events GROUP BY ALL)) GROUP BY 1""")  # fmt: skip
def null_check_argmax(spark, d):
    return summaries.null_checks(t(spark, d, "events").select(F.col("user_id").alias("funcname"), (F.col("event_id") % 9).cast("int").alias("arg_index")))


@query("SELECT callee, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE number END) AS BIGINT) AS n FROM (SELECT l_partkey AS callee, CAST(l_quantity AS INT) AS number, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS r FROM lineitem) GROUP BY 1")
def first_then_number(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("callee"), F.col("l_quantity").cast("int").alias("number"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return summaries.first_then_number(e, ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])


@query(_WITH + ", c AS (SELECT callee AS funcname, count(*) AS n FROM edges GROUP BY 1) SELECT funcname, n FROM c WHERE NOT (n >= 30 AND funcname IN (SELECT caller FROM edges WHERE callee IN (SELECT funcname FROM c WHERE n >= 40)))")
def drop_callers_of(spark, d):
    e = edges(spark, d)
    return summaries.drop_callers_of(e.groupBy(F.col("callee").alias("funcname")).agg(F.count("*").alias("n")), e, 30, 40)


@query(_WITH + "SELECT caller, callee, number FROM calls JOIN functions ON funcname = callee WHERE contains(return_type, 'void') AND params = 'struct dev *@dev,int@n,'")
def void_pointer_callees(spark, d):
    e = calls(spark, d).join(functions(spark, d).select(F.col("funcname").alias("callee"), "return_type", F.replace("params", F.lit("int@n,"), F.lit("")).alias("params")), "callee")
    return summaries.void_pointer_callees(e).select("caller", "callee", "number")


@query(f"""WITH counts AS (SELECT concat('f', CAST(l_suppkey AS STRING)) AS funcname, count(*) AS n_calls FROM lineitem GROUP BY 1), checks AS (SELECT funcname, arg_index, n FROM ({_RESET}) WHERE arg_index = 1)
SELECT funcname, coalesce(n >= 40, false) AS truth FROM counts LEFT JOIN checks USING (funcname) WHERE n_calls > 20""")  # fmt: skip
def truth_split(spark, d):
    line = t(spark, d, "lineitem").withColumn("funcname", F.concat(F.lit("f"), F.col("l_suppkey").cast("string")))
    counts = line.groupBy("funcname").agg(F.count("*").alias("n_calls"))
    checks = line.where("l_linenumber = 2").groupBy("funcname").agg(F.count("*").alias("n")).withColumn("arg_index", F.lit(1))
    yes, no = summaries.split_truth(counts, checks, 20, 40)
    return yes.select("funcname", F.lit(True).alias("truth")).union(no.select("funcname", F.lit(False)))


@query("""SELECT o_custkey AS funcname, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS names, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1""")
def pair_list_union(spark, d):
    pair = F.array(F.struct(F.lit(0).alias("idx"), F.col("o_orderpriority").alias("name")))
    flows = t(spark, d, "orders").select(F.col("o_custkey").alias("funcname"), F.col("o_orderkey").alias("pos"), pair.alias("params"), pair.alias("members"))
    return summaries.merged_flows(flows).select("funcname", F.array_join(F.array_sort(P.names_of_pairs(F.col("params"))), "|").alias("names"), F.size("members").cast("long").alias("n"))


@query(_WITH + """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN params = 'int@n,' THEN 'normal' WHEN params = '' THEN CASE WHEN contains(return_type, '*') THEN 'member' ELSE 'none' END WHEN contains(return_type, '*') THEN 'both' ELSE 'param' END AS bucket, return_type, params FROM
(SELECT CASE WHEN params = 'int@n,' THEN 'void' ELSE return_type END AS return_type, params FROM functions)) GROUP BY 1""")  # fmt: skip
def free_class_counts(spark, d):
    p = F.transform(P.parse_params(F.col("params")), lambda x, i: F.struct(i.alias("idx"), x["name"].alias("name")))
    m = F.when(F.col("return_type").contains("*") & (F.col("params") != "int@n,"), F.array(F.struct(F.lit(0).alias("idx"), F.lit("x").alias("name")))).otherwise(F.array().cast("array<struct<idx:int,name:string>>"))
    return summaries.free_classes(functions(spark, d).select("funcname", m.alias("members"), p.alias("params")))


@query("SELECT count(*) FILTER (contains(text, '*')) AS n FROM documents")
def starred_count(spark, d):
    return summaries.starred_lines(t(spark, d, "documents"), "text")


# order


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_k(spark, d):
    return ordering.top_k(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


@query("""WITH h AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1) SELECT host, page_id, row_number() OVER (ORDER BY page_id) AS number FROM h""")
def report_dedup_renumber(spark, d):
    rows = t(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), "page_id")
    return ordering.renumbered(ordering.distinct_reports(rows, "host", "page_id"), "page_id").select("host", "page_id", F.col("number").cast("long").alias("number"))


_STATES = _WITH + """, s AS (SELECT *, CASE op WHEN 'alloc' THEN 'allocated' WHEN 'free' THEN 'released' END AS made FROM trace),
p AS (SELECT *, last_value(made IGNORE NULLS) OVER (PARTITION BY path_id, sym ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM s)
"""  # fmt: skip


@query(_STATES + "SELECT path_id, sym, seq, CASE op WHEN 'free' THEN 'double_free' ELSE 'use_after_free' END AS bug FROM p WHERE state = 'released' AND op IN ('free', 'use')")
def memory_bugs(spark, d):
    return ordering.memory_bugs(trace(spark, d)).select("path_id", "sym", "seq", "bug")


@query(_STATES + "SELECT path_id, sym, seq, 'Memory is ' || made AS note FROM p WHERE made IS NOT NULL AND made IS DISTINCT FROM state")
def path_notes(spark, d):
    return ordering.path_notes(trace(spark, d)).select("path_id", "sym", "seq", "note")


@query("""SELECT path_id, seq, part, op, sym FROM (SELECT user_id AS path_id, event_id AS seq, unnest(CASE WHEN event_type = 'click' THEN [0, 1] ELSE [0] END) AS part, event_type FROM events) e,
LATERAL (SELECT CASE WHEN event_type <> 'click' THEN event_type WHEN part = 0 THEN 'free' ELSE 'alloc' END AS op, CASE WHEN event_type = 'click' AND part = 1 THEN 'n' ELSE 'o' END AS sym)""")  # fmt: skip
def realloc_events(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("path_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "realloc").otherwise(F.col("event_type")).alias("op"), F.lit("o").alias("sym"), F.lit("n").alias("new_sym"))
    return ordering.expanded_events(e).select("path_id", "seq", "part", "op", "sym")


# sets


@query("SELECT doc_id AS id, text FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, text FROM benchmark")
def bag_union(spark, d):
    return sets.bag_union(t(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text"), t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT p_name AS funcname FROM part UNION SELECT p_brand FROM part")
def set_union(spark, d):
    p = t(spark, d, "part")
    return sets.seed_allocators(p.select(F.col("p_name").alias("funcname")), p.select(F.col("p_brand").alias("funcname")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def key_difference(spark, d):
    return sets.difference(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT lower(p_name) AS p_name, min(p_size) AS p_size FROM part WHERE p_size < 10 GROUP BY 1 UNION ALL SELECT lower(p_name), 0 FROM part GROUP BY 1 HAVING min(p_size) >= 10")
def distinct_by_name(spark, d):
    p = t(spark, d, "part")
    return sets.distinct_by_name(p.where("p_size < 10").groupBy("p_name").agg(F.min("p_size").alias("p_size")), p.select("p_name").distinct().withColumn("p_size", F.lit(0)), key="p_name")


# fixpoints: all orders are calls among as many functions as there are customers

_NODES = "(SELECT count(*) FROM customer)"
# calls go from lower to higher layers, of eight
_DAG = f"""SELECT DISTINCT CASE WHEN a % 8 < b % 8 THEN a ELSE b END AS caller, CASE WHEN a % 8 < b % 8 THEN b ELSE a END AS callee
FROM (SELECT o_custkey AS a, (o_orderkey * 31) % {_NODES} AS b FROM orders) WHERE a % 8 <> b % 8"""
_CALLS = f"SELECT DISTINCT o_custkey AS caller, (o_orderkey * 7) % {_NODES} AS callee FROM orders"


def _from_orders(spark, d, sql: str) -> DataFrame:
    """The rows of one of the texts above over the orders table."""
    n = t(spark, d, "customer").count()
    return spark.sql(sql.replace(_NODES, str(n)).replace("FROM orders", "FROM {orders}"), orders=t(spark, d, "orders"))


def _names(e: DataFrame) -> DataFrame:
    return e.select(F.col("caller").alias("funcname")).union(e.select(F.col("callee").alias("funcname"))).distinct()


@query(f"""WITH RECURSIVE e AS ({_DAG}), seeds AS (SELECT DISTINCT callee FROM e WHERE callee % 16 = 7), r AS (SELECT callee AS funcname, 1 AS depth FROM seeds UNION
SELECT e.caller, r.depth + 1 FROM r JOIN e ON e.callee = r.funcname WHERE e.caller NOT IN (SELECT callee FROM seeds)) SELECT funcname, max(depth) AS depth FROM r GROUP BY 1""")  # fmt: skip
def call_depths(spark, d):
    e = _from_orders(spark, d, _DAG)
    return propagate.call_depths(e, e.where("callee % 16 = 7").select(F.col("callee").alias("funcname")), _names(e))


@query(f"WITH RECURSIVE e AS ({_CALLS}), r AS (SELECT DISTINCT callee AS funcname FROM e WHERE callee % 100 = 7 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.funcname) SELECT funcname FROM r")
def reaching_functions(spark, d):
    e = _from_orders(spark, d, _CALLS)
    return propagate.reach(e, e.where("callee % 100 = 7").select(F.col("callee").alias("funcname")))


@query(f"""WITH RECURSIVE e AS ({_CALLS}), able AS (SELECT caller FROM e GROUP BY 1 HAVING NOT bool_or(callee % 50 = 4) AND caller % 9 <> 0),
r AS (SELECT DISTINCT callee AS funcname FROM e WHERE callee % 10 = 3 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.funcname JOIN able a ON a.caller = e.caller)
SELECT funcname, CASE WHEN funcname IN (SELECT funcname FROM r) THEN 1 ELSE -1 END AS belief FROM (SELECT caller AS funcname FROM e UNION SELECT callee FROM e WHERE callee % 10 = 3)""")  # fmt: skip
def belief_fixpoint(spark, d):
    e = _from_orders(spark, d, _CALLS)
    names = _names(e)
    seeds = e.where("callee % 10 = 3").select(F.col("callee").alias("funcname")).distinct()
    return propagate.beliefs(e, seeds, names.where("funcname % 50 = 4"), names.where("funcname % 9 <> 0"), names)


# data flow and sampling


def statements(spark, d) -> DataFrame:
    """Turns of conversations as statements: user turns call, the others assign or return."""
    c = t(spark, d, "conversations")
    word = F.lower(F.substr(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit(1), F.lit(2)))
    kind = F.when(F.col("role") == "user", "call").when(F.col("turn") % 4 == 3, "return").otherwise("assign")
    args = F.array(F.struct(F.lit(0).alias("idx"), F.lit(True).alias("is_ptr"), word.alias("name")))
    return c.select(F.col("conv_id").cast("string").alias("func"), F.col("turn").alias("seq"), kind.alias("kind"), word.alias("lhs"), word.alias("rhs"), F.when(F.col("role") == "user", F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string"))).alias("callee"), args.alias("args"))


@query()
def forward_taint(spark, d):
    s = statements(spark, d)
    targets = s.where("callee IS NOT NULL").select(F.col("func").alias("caller"), "callee").distinct()
    f = dataflow.forward_taint(s, targets)
    return f.select("caller", "callee", F.array_join("passed_params", ",").alias("passed"), F.array_join("return_values", ",").alias("returned"), "direct_return")


@query()
def backward_aliases(spark, d):
    s = statements(spark, d)
    seeds = spark.createDataFrame([("g0", 0), ("g1", 0)], "funcname string, arg_index int")
    return dataflow.backward_aliases(s, dataflow.freed_arguments(s, seeds)).select("func", F.array_join(F.array_sort("names"), ",").alias("names"))


@query("""WITH s AS (SELECT CAST(conv_id AS STRING) AS func, turn, role, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')[1:2]) AS w, conv_id FROM conversations),
c AS (SELECT func, w, min(turn) AS first_turn, any_value('g' || CAST(conv_id % 3 AS STRING)) AS g FROM s WHERE role = 'user' AND conv_id % 3 < 2 GROUP BY func, w)
SELECT g AS funcname, 0 AS arg_index, count(*) AS n FROM s JOIN c USING (func, w) WHERE role <> 'user' AND turn % 4 <> 3 AND turn > first_turn GROUP BY 1""")  # fmt: skip
def null_resets(spark, d):
    names = spark.createDataFrame([("g0",), ("g1",)], "funcname string")
    return dataflow.null_resets(statements(spark, d), names).groupBy("funcname", "arg_index").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) AS kept, CAST(floor(count(*) * 0.1) AS BIGINT) AS held FROM documents GROUP BY 1")
def stratified_holdout(spark, d):
    kept, held = sampling.stratified_holdout(t(spark, d, "documents").select("doc_id", "lang"), "lang", 0.1, "doc_id")
    return kept.groupBy("lang").agg(F.count("*").alias("kept")).join(held.groupBy("lang").agg(F.count("*").alias("held")), "lang")


@query("SELECT concat('f', CAST(p_partkey AS STRING)) AS anchor, y, 5 AS n FROM part, (VALUES (1), (-1)) v(y) WHERE p_size > 45")
def training_pairs(spark, d):
    names = t(spark, d, "part").selectExpr("concat('f', CAST(p_partkey AS STRING)) AS name", "p_size")
    pairs = sampling.labelled_pairs(names.where("p_size > 45"), names.where("p_size > 40"), names.where("p_size < 10"), 5)
    return pairs.groupBy("anchor", "y").agg(F.countDistinct("other").cast("int").alias("n"))


@query("SELECT user_id AS anchor, least(count(DISTINCT event_type), 3) AS n FROM events GROUP BY 1")
def k_per_anchor(spark, d):
    pairs = t(spark, d, "events").select(F.col("user_id").alias("anchor"), F.col("event_type").alias("other")).distinct()
    return sampling.k_per_anchor(pairs, 3).groupBy("anchor").agg(F.count("*").alias("n"))


@query(_WITH + "SELECT least(count(*), 3000) AS n FROM functions")
def random_callers(spark, d):
    return sampling.random_callers(functions(spark, d)).agg(F.count("*").alias("n"))


@query()
def prototype_similarity(spark, d):
    """Raw prototypes to cosines: parse, segment, embed with the untrained model, score."""
    f = functions(spark, d)
    counts = {"f": 10.0, "n": 5.0, "dev": 5.0, "p": 3.0, "names": 4.0}
    lines = f.select(P.render(F.col("return_type"), F.col("funcname"), F.col("params")).alias("value"))
    protos = analysis.raw_prototypes(lines)
    return analysis.similarity_inference(protos, counts, protos.where(F.col("return_type").contains("*"))).select("funcname", F.round("cos", 6).alias("cos"))
