"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule votes good, bad or abstains; expectation-maximisation over the vote
patterns, from the majority of the votes on, estimates how often each rule is right on
good and on bad documents, and a document is kept if its posterior probability of being
good is at least one half. So a rule that objects to good documents as well weighs
little, and its objection alone rejects nothing; no rule is a filter of its own.
Two base rules stand above the vote: under ten words, or over a fifth of the words
inside repeated five-word windows, and the document is out.

Everything about a text is worked out in its own row; only the counts of vote
patterns (at most 3^10, some hundreds in practice) are shuffled. Five-word windows are compared by 64-bit hashes.

Defined results: a null text has no words and fails the base rules, as does an empty
one; an empty table gives an empty result; repeated rows get the same result each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import staged, table
from lapwing.llm.weak import em_posteriors, vote_patterns

LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Kinds of words are counted anew in each block of so many words: over a whole text
#: their share falls with its length.
BLOCK = 100
#: Runs of letters with single other characters between them, and one mark before and after at most.
_PLAIN = r"^\\p{P}?[\\p{L}\\p{M}]++(?:[^\\p{L}\\p{M}][\\p{L}\\p{M}]++)*+\\p{P}?$"
#: Fixed frequent words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in is that for with der die das und ist nicht mit ein le la les des et est que une dans el los las y en por con del"
_SPACE = r"\\x20\\x09-\\x0D"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words_sql(words: str = "words") -> str:
    """Words that lie in a window of five words found twice or more in the array."""
    at = ", ".join(f"get(ws, i + {k})" for k in range(1, WINDOW))
    hashes = f"slice(transform(ws, (x, i) -> xxhash64(x, {at})), 1, size(ws) - {WINDOW - 1})"
    # equal hashes lie side by side once sorted; of those, the places in order
    places = """sort_array(transform(filter(s, (e, i) -> e.h <=> get(s, i - 1).h OR e.h <=> get(s, i + 1).h), e -> e.p))"""
    covered = f"""aggregate(p, struct(-{WINDOW} AS last, 0L AS n), (z, x) -> struct(x AS last, z.n + least({WINDOW}, x - z.last) AS n), z -> z.n)"""
    slow = _let("sort_array(transform(h, (x, i) -> struct(x AS h, i AS p)))", "s", _let(places, "p", covered))
    body = _let(hashes, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {slow} END")
    return _let(words, "ws", f"CASE WHEN size(ws) <= {WINDOW} THEN 0L ELSE {body} END")


def text_features(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and what the rules look at, from each whole text; with ``carry``, also
    the document itself, as the struct ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *row)
    carried = ["row"] * carry
    t = t.selectExpr("doc_id", "t", *carried, f"regexp_extract_all(t, '[^{_SPACE}]+', 0) AS words")
    lines = _let(f"filter(split(t, '\\n'), l -> l RLIKE '[^{_SPACE}]')", "ls", "CAST(size(ls) - size(array_distinct(ls)) AS LONG)")
    return t.selectExpr(
        "doc_id",
        *carried,
        "CAST(size(words) AS LONG) AS n_words",
        f"CAST(length(t) - regexp_count(t, '[{_SPACE}]') AS LONG) AS word_chars",
        "CAST(regexp_count(t, '[#*$%&|<>]') AS LONG) AS n_symbols",
        f"{lines} AS n_dup_lines",
        f"{repeat_words_sql()} AS n_repeat_words",
        "CAST(length(t) - length(replace(t, '!', '')) AS LONG) AS n_bangs",
        "CAST(length(t) - length(replace(t, '.', '')) AS LONG) AS n_stops",
        "CAST(regexp_count(t, '[A-ZÀ-ÖØ-Þ]') AS LONG) AS n_upper",
        f"CAST(size(array_distinct(transform(words, (w, i) -> xxhash64(w, i div {BLOCK})))) AS LONG) AS n_kinds",
        f"CAST(size(filter(words, w -> w RLIKE '{_PLAIN}')) AS LONG) AS n_plain",
        f"CAST(size(array_intersect(words, split('{FUNCTION_WORDS}', ' '))) AS LONG) AS n_function",
    )


#: Of each rule, the condition for voting bad and the one for voting good where it is
#: not bad; else it abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "bangs": ("4 * n_bangs > n_words", "20 * n_bangs <= n_words"),
    "upper": ("2 * n_upper > word_chars", "5 * n_upper <= word_chars"),
    "repeats": ("5 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    "dup_lines": ("n_dup_lines >= 3 AND 10 * n_dup_lines > n_words", "n_dup_lines = 0"),
    "word_length": ("word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    "variety": ("n_words >= 30 AND 20 * n_kinds < 3 * n_words", "3 * n_kinds >= n_words"),
    "sentences": ("n_words >= 60 AND 60 * n_stops < n_words", "n_words >= 20 AND 30 * n_stops >= n_words"),
    "plain_words": ("5 * n_plain < 3 * n_words", "5 * n_plain >= 4 * n_words"),
    "function_words": ("n_words >= 40 AND n_function = 0", "n_function >= 3"),
}


def with_votes(features: DataFrame) -> DataFrame:
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END" for bad, good in RULES.values())
    base = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
    return features.selectExpr("*", f"({base}) AS base_failed", f"array({votes}) AS votes")


def judged(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The features of each document with votes, base_failed, posterior and kept."""
    voted = staged(with_votes(text_features(docs, carry=carry)), "quality")
    model = em_posteriors(vote_patterns(voted), len(RULES)).select("votes", F.round("posterior", 9).alias("posterior"))
    out = voted.join(F.broadcast(model), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior of each document."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; none of them is shuffled."""
    return judged(docs, carry=True).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
