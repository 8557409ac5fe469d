"""Readers and writers of the analysis' text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROTOTYPE = "return_type string, funcname string, params string, file string, begin array<int>, end array<int>, number int"


def _numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, pos, value): lines with a position that grows within a file."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("pos"), "value")


def until_blank(lines: DataFrame) -> DataFrame:
    """Lines before the first blank one of each file."""
    ends = lines.where(F.trim("value") == "").groupBy("source").agg(F.min("pos").alias("_end"))  # a row for each file
    return lines.join(ends, "source", "left").where("_end IS NULL OR pos < _end").drop("_end")


def read_call_graph(spark: SparkSession, path: str, fix_quotes: bool = False) -> DataFrame:
    """(pos, caller, callees): caller groups of a nested text file.

    A caller's JSON line is followed by tab-indented callee lines. Callees are in file
    order, as written: ``dedupe`` counts them. One row is one group, so groups are never
    split between tasks.
    """
    groups = _numbered(spark, path, "\n{")
    text = F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    if fix_quotes:
        text = F.regexp_replace(text, "'", '"')
    parts = F.split(F.regexp_replace(text, r"\s+$", ""), r"\n\t")
    rows = groups.where(F.trim("value") != "").select("pos", parts.alias("p"))
    return rows.select(
        "pos",
        F.from_json(F.get("p", F.lit(0)), PROTOTYPE).alias("caller"),
        F.transform(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda x: F.from_json(x, PROTOTYPE)).alias("callees"),
    )


def edges(groups: DataFrame) -> DataFrame:
    """(pos, caller, nth, callee, return_type, params, number): one row for each callee line."""
    flat = groups.select("pos", F.col("caller.funcname").alias("caller"), F.posexplode("callees").alias("nth", "c"))
    return flat.select("pos", "caller", "nth", F.col("c.funcname").alias("callee"), "c.return_type", "c.params", F.coalesce("c.number", F.lit(1)).alias("number"))


def write_call_graph(groups: DataFrame, path: str) -> None:
    """Caller line, then a tab-indented line for each callee."""
    lines = F.concat_ws("\n", F.to_json("caller"), F.transform("callees", lambda c: F.concat(F.lit("\t"), F.to_json(c))))
    groups.select(lines.alias("value")).write.mode("overwrite").text(path)


def read_prototypes(spark: SparkSession, path: str) -> DataFrame:
    """All prototypes of a JSON-lines or call-graph file, with their position; reading ends at a blank line."""
    lines = until_blank(_numbered(spark, path))
    return lines.select("pos", F.col("value").startswith("\t").alias("is_callee"), F.from_json(F.trim("value"), PROTOTYPE).alias("p")).select("pos", "is_callee", "p.*").where("funcname IS NOT NULL")


def read_callers(spark: SparkSession, path: str) -> DataFrame:
    return read_prototypes(spark, path).where("NOT is_callee")


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """(funcname, cos): the last token is the score, what stands before is the name."""
    lines = _numbered(spark, path)
    m = r"^(.*\S)\s+(\S+)\s*$"
    return lines.select(F.regexp_replace(F.regexp_extract("value", m, 1), r"\s+", "").alias("funcname"), F.regexp_extract("value", m, 2).cast("double").alias("cos"), "pos").where("funcname <> ''")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, vector): ``name|floats``."""
    cut = F.split("value", r"\|", 2)
    lines = until_blank(_numbered(spark, path))
    return lines.select("pos", F.trim(F.get(cut, F.lit(0))).alias("name"), F.transform(F.split(F.trim(F.get(cut, F.lit(1))), r"\s+"), lambda x: x.cast("double")).alias("vector"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, count, logp) of a tab-separated file whose <total> row is the divisor."""
    rows = spark.read.csv(path, sep="\t", schema="word string, count double", quote="")
    total = rows.where("word = '<total>'").select(F.max("count").alias("total"))
    return rows.where("word <> '<total>'").join(F.broadcast(total)).select("word", "count", F.log10(F.col("count") / F.col("total")).alias("logp"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, tokens) of a normalised file; the max_length trailer is left out."""
    return until_blank(_numbered(spark, path)).select("pos", F.split(F.trim("value"), " ").alias("tokens"))


def last_embeddings(embeddings: DataFrame) -> DataFrame:
    """(name, vector): the last vector of each name, in order of the file's lines."""
    return embeddings.groupBy("name").agg(F.max_by("vector", "pos").alias("vector"))


def flows_by_caller(flows: DataFrame) -> DataFrame:
    """(caller, flows): a caller's flows, which are as many as it has target callees."""
    rest = F.struct(*[c for c in flows.columns if c != "caller"])
    return flows.groupBy("caller").agg(F.sort_array(F.collect_list(rest)).alias("flows"))


def caller_count(spark: SparkSession, path: str) -> DataFrame:
    return read_callers(spark, path).agg(F.count("*").alias("n"))


def read_alloc_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("caller string, callee string, passed_params array<string>, return_values array<string>, direct_return int").json(path)


def read_free_flows(spark: SparkSession, path: str) -> DataFrame:
    """(pos, funcname, params, members): flat alternating lists as (idx, name) pairs."""
    from lapwing.functions.prototypes import pair_up

    raw = spark.read.schema("funcname string, param_names array<string>, member_name array<string>").json(path)
    return raw.select(F.monotonically_increasing_id().alias("pos"), "funcname", pair_up(F.col("param_names")).alias("params"), pair_up(F.col("member_name")).alias("members"))


def read_reassignments(spark: SparkSession, path: str) -> DataFrame:
    """(funcname, arg_index, n) of whitespace-separated lines; n is 1 where it is missing.
    A name's last line counts, and a file that isn't there has none."""
    p = F.split(F.trim("value"), r"\s+")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "funcname string, arg_index int, n long")
    lines = _numbered(spark, path).where(F.trim("value") != "")
    rows = lines.select(F.struct("source", "pos").alias("at"), F.get(p, F.lit(0)).alias("funcname"), F.get(p, F.lit(1)).cast("int").alias("arg_index"), F.coalesce(F.get(p, F.lit(2)).cast("long"), F.lit(1)).alias("n"))
    return rows.groupBy("funcname").agg(F.max_by(F.struct("arg_index", "n"), "at").alias("r")).select("funcname", "r.arg_index", "r.n")


def read_compile_db(spark: SparkSession, path: str, drop_flags: tuple[str, ...] = ("-D__GENKSYMS__",), add: str = "") -> DataFrame:
    """(directory, command, file) of a compile database with commands or argument lists."""
    rows = spark.read.schema("directory string, command string, arguments array<string>, file string").json(path, multiLine=True)
    command = F.coalesce("command", F.array_join("arguments", " "))
    for flag in drop_flags:
        command = F.replace(command, F.lit(flag), F.lit(""))
    return rows.select("directory", (F.concat(command, F.lit(f" {add}")) if add else command).alias("command"), "file")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a seed list (and the argument's index, where the line has one)."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("funcname"), F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(0)).alias("arg_index"))


def write_similarity(scores: DataFrame, path: str) -> None:
    """``name score`` lines, best first."""
    scores.orderBy(F.desc("cos"), "funcname").select(F.concat_ws(" ", "funcname", F.col("cos").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def plain_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of an overlap or allocator file; lines that begin with - or { are none."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*([-{]|$)")).select(F.trim("value").alias("funcname"))


def write_report(rows: DataFrame, path: str) -> None:
    """Table rows (number, row_html) in order, as lines of HTML part files."""
    numbered = F.regexp_replace("row_html", r"<tr[^>]*>", F.concat(F.lit('<tr data-number="'), F.col("number").cast("string"), F.lit('">')))
    rows.repartitionByRange("number").sortWithinPartitions("number").select(numbered.alias("value")).write.mode("overwrite").text(path)


def write_summaries(summaries: DataFrame, normal_path: str, customised_path: str) -> None:
    """Names of normal summaries as text, customised ones as JSON lines with names only."""
    from lapwing.functions.prototypes import names_of_pairs
    from lapwing.operators.summaries import is_normal_free

    normal = is_normal_free(F.col("params"), F.col("members"))
    summaries.where(normal).select(F.col("funcname").alias("value")).write.mode("overwrite").text(normal_path)
    summaries.where(~normal).select("funcname", names_of_pairs(F.col("params")).alias("param_names"), names_of_pairs(F.col("members")).alias("member_name")).write.mode("overwrite").json(customised_path)
