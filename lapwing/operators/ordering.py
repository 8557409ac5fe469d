"""Top-k, deduplication in order, report rows, and state along ordered traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.staging import staged


def sorted_scores(df: DataFrame, score: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie)


def top_k(df: DataFrame, score: str, tie: str, k: int = 10) -> DataFrame:
    return sorted_scores(df, score, tie).limit(k)


def distinct_reports(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each report hash, the first."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])


def renumbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """1..n in order. Range partitions are counted, and each numbers its rows from what
    lies before it, so no task holds all rows.

    The dealt rows are written once with their places: range bounds are sampled and
    partitions joined anew whenever such a plan runs, so counts and rows must not be two
    runs of it. Equal rows are numbered one after the other.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # partition in the upper 31 bits, place in the lower 33
    at = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))  # one row for each partition
    numbered = at.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return numbered.drop("_part", "_at", "_before")


def report_hash(row_html):
    return F.regexp_extract(row_html, r'reportHash=([^"&>]*)', 1)


def report_rows(html: DataFrame, column: str = "html") -> DataFrame:
    """(pos, report_hash, row_html) of the table rows with a report hash."""
    rows = html.select(F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))).alias("pos", "row_html"))
    return rows.select("pos", report_hash(F.col("row_html")).alias("report_hash"), "row_html").where("report_hash <> ''")


def cleaned_report(html: DataFrame, column: str = "html") -> DataFrame:
    """Report rows, one for each hash, numbered anew."""
    return renumbered(distinct_reports(report_rows(html, column), "report_hash", "pos"), "pos")


def expanded_events(events: DataFrame) -> DataFrame:
    """Trace events with realloc as what it does: with a null pointer it allocates, else it
    frees the old symbol and allocates the new one.

    ``events`` (path_id, seq, op, sym, new_sym, addr_of, customised).
    """
    free = F.struct(F.lit(0).alias("part"), F.lit("free").alias("op"), F.col("sym").alias("sym"))
    alloc = F.struct(F.lit(1).alias("part"), F.lit("alloc").alias("op"), F.coalesce("new_sym", "sym").alias("sym"))
    same = F.struct(F.lit(0).alias("part"), F.col("op").alias("op"), F.col("sym").alias("sym"))
    steps = F.when((F.col("op") == "realloc") & F.col("sym").isNull(), F.array(alloc)).when(F.col("op") == "realloc", F.array(free, alloc)).otherwise(F.array(same))
    rest = [c for c in events.columns if c not in ("op", "sym", "new_sym")]
    return events.select(*rest, F.explode(steps).alias("s")).select(*rest, "s.part", "s.op", "s.sym")


def trace_states(events: DataFrame, path: str = "path_id", sym: str = "sym", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Adds state: what the last alloc or free before left the symbol in on its path."""
    w = Window.partitionBy(path, sym).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = F.when(F.col("op") == "alloc", "allocated").when(F.col("op") == "free", "released")
    return events.withColumn("state", F.last(made, ignorenulls=True).over(w))


def memory_bugs(events: DataFrame, path: str = "path_id", sym: str = "sym", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Events on released symbols: double_free for a free, use_after_free for a use.

    free(&x) isn't a free of x; a customised free of a symbol without state is passed over.
    """
    rows = events
    if "addr_of" in events.columns:
        rows = rows.where(~((F.col("op") == "free") & F.coalesce("addr_of", F.lit(False))))
    if "customised" in events.columns:
        mine = (F.col("op") == "free") & F.coalesce("customised", F.lit(False))
        w = Window.partitionBy(path, sym).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        known = F.max(F.col("op").isin("alloc", "free") & ~mine).over(w)
        rows = rows.withColumn("_known", F.coalesce(known, F.lit(False))).where(~mine | F.col("_known")).drop("_known")
    rows = trace_states(rows, path, sym, order)
    bug = F.when((F.col("state") == "released") & (F.col("op") == "free"), "double_free").when((F.col("state") == "released") & (F.col("op") == "use"), "use_after_free")
    return rows.withColumn("bug", bug).where("bug IS NOT NULL")


def path_notes(events: DataFrame, path: str = "path_id", sym: str = "sym", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Events that change a symbol's state, with a note."""
    rows = trace_states(events, path, sym, order)
    now = F.when(F.col("op") == "alloc", "allocated").when(F.col("op") == "free", "released")
    return rows.withColumn("now", now).where("now IS NOT NULL AND NOT (now <=> state)").withColumn("note", F.concat(F.lit("Memory is "), "now"))
