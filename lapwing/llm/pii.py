"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns give candidate spans. Five labelers vote on each candidate: its form
(checked digits, parts, lengths), a gazetteer (known top-level domains, area codes
and words for secrets), the words before it, its shape (the mix of characters), and
its surroundings (glued to further letters or digits or not). Expectation-
maximisation over the vote patterns estimates the labelers' reliabilities, its
posteriors train a logistic span classifier over kind and votes, and candidates that
the classifier takes are added to the base spans. Base spans (email, ip, card,
phone) are decided by their form alone and always stay.

Spans are found as the gaps between the pieces of a split by the same pattern, so
start and end are code points of the whole text; running sums are made by doubling, so
work grows with the text's length and n log n of its matches. All patterns move on in one pass:
their repetitions are possessive, and one that must begin at the head of a run looks
back one character (or stands where the last match ended). Work on a text starts
only if it holds the characters its pattern needs.

Defined results: a null text counts as empty and has no spans; an empty table gives
an empty result; repeated rows get the same result each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import staged, table
from lapwing.llm.weak import em_posteriors, logistic_scores, vote_patterns

_LOCAL = "A-Za-z0-9._%+-"
#: Fixed patterns of the base kinds: (what a text must hold, pattern, condition on a match m).
BASE = {
    "email": ("contains(t, '@')", rf"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"t RLIKE '[0-9]\\.[0-9]'", r"(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)"),
    "card": (r"t RLIKE '[0-9](?:[ -]?[0-9]){15}'", r"[0-9](?:[\\x20-]?[0-9])++", "{digits} BETWEEN 16 AND 19 AND {luhn}"),
    "phone": ("contains(t, '+')", r"\\+[0-9][\\x20().0-9-]+[0-9]", "{digits} BETWEEN 8 AND 15"),
}
#: Wider patterns whose matches are candidates only.
WIDER = {
    "email_spelled": (r"t RLIKE '(?i)[\\[(]at[\\])]'", rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++ ?[\\[(]at[\\])] ?[a-z0-9-]++ ?(?:[\\[(]dot[\\])]|\\.) ?[a-z]++"),
    "phone_local": (r"t RLIKE '[0-9]{3}[ .-][0-9]{4}'", r"(?<![0-9+] |[0-9+.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "national_id": (r"t RLIKE '[0-9]-[0-9]{2}-[0-9]'", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": (r"contains(t, '=') OR contains(t, ':')", r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"'']? ?[=:] ?[\"'']?[a-z0-9+/_.-]{8,}+"),
}
KINDS = [*BASE, *WIDER]
#: Characters before a candidate that are read, and code points of a block of text.
BEFORE, BLOCK = 24, 4096
LABELERS = ("form", "gazetteer", "context", "shape", "surroundings")

_DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
_LUHN = """transform(array(reverse(regexp_replace(m, '[^0-9]', ''))), d -> aggregate(sequence(1, length(d)), 0, (z, k) ->
    z + CASE WHEN k % 2 = 1 THEN int(substr(d, k, 1)) ELSE 2 * int(substr(d, k, 1)) - CASE WHEN int(substr(d, k, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0)[0]"""
#: Fixed gazetteers: common top-level domains, and words that announce personal data.
_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
_CUES = "mail|e-mail|contact|phone|tel|call|mobile|fax|ssn|social|card|visa|ip|host|address|login|user|password|token|secret|key"


def scan_sql(values: str, join: str) -> str:
    """Running results over an array: ``join`` of x and y, for y before x. Each of the
    log2(n) steps joins what lies twice as far back, so no prefix is walked or copied
    anew for each element."""
    step = f"transform(z, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN transform(array(get(z, i - shiftleft(1, k))), y -> {join})[0] ELSE x END)"
    return f"transform(array({values}), v -> CASE WHEN size(v) < 2 THEN v ELSE aggregate(sequence(0, CAST(ceil(log2(size(v))) AS INT) - 1), v, (z, k) -> {step}) END)[0]"


def spans_sql(kind: str, need: str, pattern: str, keep: str = "true") -> str:
    """Array of (kind, s, e, votes) for the matches of a pattern in the column t.

    The text lies in the pieces between matches and the matches; running lengths give the
    places, and what stands around a match is read from its neighbours, never by a place in
    the whole text.
    """
    keep = keep.replace("{digits}", _DIGITS).replace("{luhn}", f"({_LUHN})")
    empty = "CAST(array() AS array<struct<kind:int,s:int,e:int,votes:string>>)"
    ends = scan_sql("transform(ms, (m, i) -> length(m) + length(get(ps, i)))", "x + y")
    # the shortest match has five characters: five of them hold what lies BEFORE characters back
    back = ", ".join(f"coalesce(right(get(ps, i - {k}), {BEFORE}), ''), coalesce(get(ms, i - {k}), '')" for k in range(5, 0, -1))
    around = f"struct(lower(right(concat({back}, right(get(ps, i), {BEFORE})), {BEFORE})) AS b, left(concat(left(get(ps, i + 1), 1), coalesce(left(get(ms, i + 1), 1), '')), 1) AS a)"
    span = f"struct({KINDS.index(kind)} AS kind, get(es, i) - length(m) AS s, get(es, i) AS e, transform(array({around}), c -> {_votes_sql(kind)})[0] AS votes)"
    if keep != "true":
        span = f"CASE WHEN {keep} THEN {span} END"
    found = f"transform(array({ends}), es -> filter(transform(ms, (m, i) -> {span}), x -> x IS NOT NULL))[0]"
    split_ = f"transform(array(split(t, '{pattern}', -1)), ps -> {found})[0]"
    return f"CASE WHEN {need} THEN transform(array(regexp_extract_all(t, '{pattern}', 0)), ms -> CASE WHEN size(ms) = 0 THEN {empty} ELSE {split_} END)[0] ELSE {empty} END"


def _votes_sql(kind: str) -> str:
    """Votes of the labelers on a match m with c.b before and c.a after it, as one string
    of digits (2: abstains)."""
    form = "2"
    if kind in BASE:
        form = "1"
    elif kind == "secret":
        form = "CASE WHEN m RLIKE '[0-9]' AND m RLIKE '[A-Za-z0-9+/_.-]{12,}$' THEN 1 ELSE 0 END"
    elif kind == "national_id":
        form = "CASE WHEN m RLIKE '^(?:000|666|9)|-00-|-0000$' THEN 0 ELSE 1 END"
    gazetteer = f"CASE WHEN m RLIKE '(?i)[.](?:{_DOMAINS})$' OR m RLIKE '(?i)^(?:password|passwd|token|secret|api)' THEN 1 ELSE 2 END"
    context = f"CASE WHEN c.b RLIKE '(?<![a-z])(?:{_CUES})[^a-z]*$' THEN 1 ELSE 2 END"
    value = r"regexp_replace(m, '^.*[=: ]', '')" if kind == "secret" else "m"  # what the word before it announces
    shape = rf"CASE WHEN regexp_replace({value}, '[^0-9A-Za-z]', '') RLIKE '^(.)\\1*+$' THEN 0 WHEN length(m) BETWEEN 7 AND 80 THEN 1 ELSE 2 END"
    around = "CASE WHEN right(c.b, 1) RLIKE '[A-Za-z0-9]' OR c.a RLIKE '[A-Za-z0-9]' THEN 0 ELSE 1 END"
    return f"concat({', '.join(f'({v})' for v in (form, gazetteer, context, shape, around))})"


def candidates(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, base spans by kind (arrays of s and e) and cands (kind, s, e, votes) of
    each text; with ``carry``, also the document itself, as the struct ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *row)
    carried = ["row"] * carry
    base = [f"{spans_sql(kind, *BASE[kind])} AS {kind}" for kind in BASE]
    wider = [spans_sql(kind, *WIDER[kind]) for kind in WIDER]
    t = t.selectExpr("doc_id", *carried, *base, f"concat({', '.join(wider)}) AS wider")
    bare = [f"transform({kind}, x -> struct(x.s AS s, x.e AS e)) AS {kind}" for kind in BASE]
    return t.selectExpr("doc_id", *carried, *bare, f"concat({', '.join(BASE)}, wider) AS cands")


def span_model(found: DataFrame) -> DataFrame:
    """(kind, votes, score) for each pattern of votes on the candidates."""
    each = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes")
    numbers = [F.when(F.substring("votes", k + 1, 1) == "2", -1).otherwise(F.substring("votes", k + 1, 1).cast("int")) for k in range(len(LABELERS))]
    counts = staged(each.groupBy("kind", "votes").agg(F.count("*").alias("n")).withColumn("v", F.array(*numbers)), "span-votes")
    reliable = em_posteriors(counts.groupBy("v").agg(F.sum("n").alias("n")).withColumnRenamed("v", "votes"), len(LABELERS))
    joined = counts.join(F.broadcast(reliable.select(F.col("votes").alias("v"), "posterior")), "v")
    kinds = [(F.col("kind") == k).cast("double") for k in range(len(KINDS))]
    says = [(F.get("v", F.lit(k)) == value).cast("double") for k in range(len(LABELERS)) for value in (0, 1)]
    rows = joined.select("kind", "votes", F.array(F.lit(1.0), *kinds, *says).alias("x"), F.round("posterior", 9).alias("y"), "n")
    return logistic_scores(rows, 1 + len(kinds) + len(says)).select("kind", "votes", "score")


def personal_data(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base spans and all: the base spans and the candidates that the classifier
    takes and that touch no base span, as (kind, s, e), by kind and start."""
    found = staged(candidates(docs, carry=carry), "pii")
    # at most kinds * 3^labelers patterns
    taken = [f"{r['kind']}:{r['votes']}" for r in span_model(found).where("score >= 0.5").select("kind", "votes").collect()]
    wanted = F.array(*[F.lit(x) for x in sorted(taken)]) if taken else F.array().cast("array<string>")
    base = F.concat(*[F.expr(f"transform({k}, x -> struct({i} AS kind, x.s AS s, x.e AS e))") for i, k in enumerate(BASE)])
    found = found.withColumn("base", base)
    extra = F.filter("cands", lambda c: (c["kind"] >= len(BASE)) & F.array_contains(wanted, F.concat_ws(":", c["kind"].cast("string"), c["votes"])))
    extra = F.transform(extra, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    found = found.withColumn("extra", extra).withColumn("extra", F.expr(free_sql("extra", "base")))
    return found.withColumn("all", F.sort_array(F.concat("base", "extra")))


def free_sql(spans: str, others: str) -> str:
    """The spans that touch none of the others. Both are put in order of their starts;
    then the furthest end before a span and the next start after it tell."""
    n = len(BASE)
    order = f"sort_array(transform(concat({spans}, {others}), x -> struct(x.s AS s, x.e AS e, x.kind AS kind)))"
    before = scan_sql(f"transform(o, x -> CASE WHEN x.kind < {n} THEN x.e ELSE 0 END)", "greatest(x, y)")
    after = f"reverse({scan_sql(f'transform(reverse(o), x -> CASE WHEN x.kind < {n} THEN x.s ELSE 2147483647 END)', 'least(x, y)')})"
    free = f"filter(transform(o, (x, i) -> CASE WHEN x.kind >= {n} AND get(b, i) <= x.s AND get(a, i) >= x.e THEN struct(x.kind AS kind, x.s AS s, x.e AS e) END), x -> x IS NOT NULL)"
    return f"CASE WHEN size({spans}) = 0 OR size({others}) = 0 THEN {spans} ELSE transform(array({order}), o -> transform(array({before}), b -> transform(array({after}), a -> {free})[0])[0])[0] END"


def spans_text(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(column), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked_sql(text: str, spans: str) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first span.

    The text is read in blocks of ``BLOCK`` code points, so that a place costs a block's
    length at most to find.
    """
    names = ", ".join(f"'{k}'" for k in KINDS)
    order = f"sort_array(transform({spans}, x -> struct(x.s AS s, -x.e AS e, x.kind AS kind)))"
    ends = scan_sql("transform(o, x -> -x.e)", "greatest(x, y)")
    heads = "filter(transform(o, (x, i) -> CASE WHEN i = 0 OR get(es, i - 1) <= x.s THEN i END), i -> i IS NOT NULL)"
    # text from f to s, out of whole blocks and parts of the first and last one
    cut = f"""CASE WHEN f div {BLOCK} = s div {BLOCK} THEN substr(get(bs, f div {BLOCK}), f % {BLOCK} + 1, s - f)
        ELSE concat(substr(get(bs, f div {BLOCK}), f % {BLOCK} + 1), array_join(slice(bs, f div {BLOCK} + 2, s div {BLOCK} - f div {BLOCK} - 1), ''), coalesce(left(get(bs, s div {BLOCK}), s % {BLOCK}), '')) END"""
    cut = cut.replace(f"f div {BLOCK}", f"int(f div {BLOCK})").replace(f"s div {BLOCK}", f"int(s div {BLOCK})")
    piece = lambda f, s: f"coalesce(transform(array(struct({f} AS f, {s} AS s)), p -> {cut.replace('f div', 'p.f div').replace('f %', 'p.f %').replace('s div', 'p.s div').replace('s %', 'p.s %').replace('s - f', 'p.s - p.f')})[0], '')"
    before = piece("CASE WHEN i = 0 THEN 0 ELSE get(es, h - 1) END", "get(o, h).s")
    parts = f"transform(hs, (h, i) -> concat({before}, '<', get(array({names}), get(o, h).kind), '>'))"
    rest = piece("get(es, size(es) - 1)", f"length({text})")
    body = f"concat(array_join({parts}, ''), {rest})"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"
    return f"transform(array({order}), o -> transform(array({ends}), es -> transform(array({heads}), hs -> transform(array({blocks}), bs -> {body})[0])[0])[0])[0]"


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced by its kind in angle brackets; a
    run of overlapping spans by that of the first (of equal starts, the longest) one.
    n_chars, where there is such a column, is counted anew. Documents without spans stay
    as they are, and no document is shuffled. A null text stays null, an empty table gives
    an empty one, repeated rows stay repeated."""
    found = personal_data(docs, carry=True)
    out = found.select("row", F.size("all").alias("spans"), F.expr(f"CASE WHEN size(`all`) = 0 THEN row.text ELSE {masked_sql('row.text', '`all`')} END").alias("clean"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    own["text"] = F.col("clean")
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("spans") == 0, own["n_chars"]).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[column.alias(c) for c, column in own.items()])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("all").alias("spans"))
