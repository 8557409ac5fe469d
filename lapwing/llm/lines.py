"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions only.

Two lines are near-copies if their edit distance is at most the threshold of the longer
one: a tenth of its length, ``BANDS`` at most. Cut the shorter one into threshold + 1
segments: an edit spoils one segment at most, so one of them occurs in the longer line,
shifted by no more than the edits left and right of it allow.

Where a line has enough places to do so, its content cuts it: a segment ends at each ``CUT``.
An edit spoils two segments at most, and two lines share all but 2 * threshold of either's, wherever they lie. Their first common
one, the longest first, is among the first 2 * threshold + 1 of both: a line is filed under
these few, with no shifts to ask for. That finds each pair of which one line has so many
segments. Lines that have fewer file equal parts besides, under (threshold, length, number,
segment), and ask for their own substrings that could be a part of a line as long or
shorter, at the few shifts that can matter. Lines that meet are verified by a banded
bit-parallel edit distance.

A bucket in which more than ``HOT`` lines meet as many is not compared pair by pair. An edit
changes two counts of characters by one at most, so of 2 * threshold + 1 sets of characters
two lines have the same counts in one: the bucket is dealt out by these first. That parts
copies with words changed. Lines that more than ``CROWD`` times as many still meet, such as
those that differ in a number, go on in their first bucket. What its lines share is taken out: the segment, then what all of them begin and end with. What
is left, with the places where something was taken out, is cut and joined again within
the bucket, until buckets are small, or no more characters than the threshold are left;
lines that these are left of at the same places are linked by a star. So lines that differ
in a number cost a few rows each, and no pairs.

Equal lines are joined as one. Lines are told apart by 128-bit hashes; the 64-bit ones that
the join carries only name candidates, whose texts are compared. Classes are connected
components of the links; of each class the line of the smallest (doc_id, line_no) is kept.

Defined results: a null text has no lines; lines are cut at line feeds, numbered from 0,
and empty ones are left out; an empty table gives an empty result. Lines under ten code
points have threshold 0: they match exactly only. Repeated rows, and rows without a
doc_id, have their lines each; exactly one line of a class is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.common import dropped, staged, table
from lapwing.llm.graph import components

#: (least length, threshold), in order: a tenth of the length, two at most.
BANDS = ((10, 1), (40, 2))
#: Lines on the smaller side of a bucket that is compared pair by pair: so many comparisons
#: of signs cost a line less than its next keys, a dozen with a copy of the text.
HOT = 64
#: Times ``HOT``: lines dealt out by their counts are narrow rows, and their next keys, with
#: copies of the text on every level, cost more than so many comparisons of signs.
CROWD = 8
#: A segment cut by content ends at this character. A single one is found without a regular
#: expression, and a frequent one of a language's writing leaves segments longer than a word.
CUT = "n"
#: Lines with more than this part of all places are labelled by a broadcast.
PARTS = 1024
#: Characters whose counts are compared before a pair is verified.
LETTERS = "eanrt"
#: The same for lines in large buckets, which are often copies with a word changed.
CROWD_LETTERS = "etaoinshrdlcmkbf"
#: More of them, beside eight bits of the length.
CROWD_OTHERS = " ugpwvy.,jqxz-"
#: Those whose counts are compared before the texts of a pair are.
MORE_LETTERS = "etaoinshrdlucmpfgwybv. ,;0123456789"


def _ranges(bands: tuple) -> list[tuple[int, int, int]]:
    """(threshold, least length, first length beyond) of each band."""
    return [(k, lo, bands[i + 1][0] if i + 1 < len(bands) else 2**31 - 1) for i, (lo, k) in enumerate(bands)]


def threshold_sql(length: str, bands: tuple = BANDS) -> str:
    cases = " ".join(f"WHEN {length} >= {lo} THEN {k}" for lo, k in reversed(bands))
    return f"CASE {cases} ELSE 0 END"


def specs_sql(bands: tuple) -> str:
    """Array of (own, threshold, d, number, shift) that a line of n code points makes keys
    of: its own segments (own 1), and the substrings it asks for in lines of n - d.

    The cases are data, not code: one short expression makes every key of them.
    """
    ranges = _ranges(bands)
    cuts = sorted({x for k, lo, beyond in ranges for x in (lo - k, lo, beyond)})
    cases = []
    for low, high in zip(cuts, cuts[1:]):  # noqa: B905
        rows = []
        for threshold, lo, beyond in ranges:
            if lo - threshold <= low < beyond:
                rows += [(1, threshold, 0, i, 0) for i in range(threshold + 1)]
            if lo <= low < beyond:
                # i segments lie to the left, threshold - i to the right; edits there bound the shift
                rows += [(0, threshold, d, i, x) for d in range(threshold + 1) for i in range(threshold + 1) for x in range(-threshold, threshold + 1) if abs(x) <= i and abs(d - x) <= threshold - i]
        listed = ", ".join("named_struct('own', {}, 'threshold', {}, 'd', {}, 'number', {}, 'shift', {})".format(*r) for r in rows)
        cases.append(f"WHEN n >= {low} AND n < {high} THEN array({listed})")
    return f"CASE {' '.join(cases)} END"


def _equal_parts(lines: DataFrame, bands: tuple) -> DataFrame:
    """The lines' rows (id, line, n, ...) with own, ask, threshold, ends, at, size and the key k
    of each substring that one files or asks for; ``ends`` is the length of what is compared."""
    # four bytes for each code point: a substring is cut without counting through the line
    t = lines.withColumn("_points", F.encode("line", "UTF-32")).selectExpr("*", f"inline({specs_sql(bands)})").withColumn("base", F.expr("int((n - d) div (threshold + 1))"))
    longer = "(threshold + 1 - (n - d) % (threshold + 1))"  # segments from this number on are longer by one
    t = t.selectExpr("*", f"number * base + greatest(0, number - {longer}) + shift AS at", f"base + CASE WHEN number >= {longer} THEN 1 ELSE 0 END AS size")
    t = t.where("n > d AND size > 0 AND at >= 0 AND at + size <= n")
    t = t.withColumn("k", F.expr("xxhash64(threshold, n - d, number, substr(_points, 4 * at + 1, 4 * size))"))
    return t.selectExpr(*lines.columns, "k", "own", "1 - own AS ask", "threshold", "n - d AS ends", "at", "size")


def _most_sql(bands: tuple) -> str:
    """The greatest threshold that a line of n code points can have with a longer one."""
    return "CASE " + " ".join(f"WHEN n >= {lo - k} THEN {k}" for k, lo, _ in reversed(_ranges(bands))) + " ELSE 0 END"


def _segment_sql(segment: str) -> str:
    """A key of a segment: 48 bits of its hash below its length, so that the longest comes first."""
    return f"shiftleft(bigint(~octet_length({segment})), 48) | (xxhash64({segment}) & {2**48 - 1})"


def _by_content(lines: DataFrame, bands: tuple) -> DataFrame:
    """The lines with their segments cut by content, the hashes of the first ones (``firsts``),
    and whether these are enough to find each pair of the line (``enough``)."""
    t = lines.withColumn("segments", F.split("line", CUT)).withColumn("most", F.expr(_most_sql(bands)))
    # in an order that is the same for all lines; equal segments count as often as they occur
    ordered = f"sort_array(transform(segments, c -> {_segment_sql('c')}))"
    return t.selectExpr(*lines.columns, "segments", f"array_distinct(slice({ordered}, 1, 2 * most + 1)) AS firsts", "size(segments) > 2 * most AS enough")


def _first_keys(lines: DataFrame, bands: tuple) -> DataFrame:
    """(k, id, sign, own, ask): the keys of a line by content, and those of its equal parts where it needs them."""
    t = _by_content(lines, bands)
    content = "transform(firsts, h -> named_struct('k', h, 'own', 1, 'ask', 1))"
    base, longer = "int((n - x.d) div (x.threshold + 1))", "(x.threshold + 1 - (n - x.d) % (x.threshold + 1))"
    placed = f"transform({specs_sql(bands)}, x -> struct(x, x.number * {base} + greatest(0, x.number - {longer}) + x.shift AS at, {base} + IF(x.number >= {longer}, 1, 0) AS size))"
    fitting = f"filter({placed}, y -> n > y.x.d AND y.size > 0 AND y.at >= 0 AND y.at + y.size <= n)"
    parts = f"transform({fitting}, y -> named_struct('k', xxhash64(y.x.threshold, n - y.x.d, y.x.number, substr(points, 4 * y.at + 1, 4 * y.size)), 'own', y.x.own, 'ask', 1 - y.x.own))"
    # bound once: inside the inner function the line would be encoded anew for each key
    parts = f"transform(array(encode(line, 'UTF-32')), points -> {parts})[0]"
    return t.selectExpr("id", "sign", f"inline(IF(enough, {content}, concat({content}, {parts})))")


def _content_rows(lines: DataFrame, large: DataFrame, bands: tuple) -> DataFrame:
    """Rows as ``_equal_parts`` makes them, of segments cut by content that are keys of
    their lines in ``large``; lines meet again if what is left of them can be within the threshold by length."""
    firsts = _by_content(lines, bands).select(*lines.columns, "segments", F.explode("firsts").alias("first"))
    t = firsts.join(large.withColumnRenamed("k", "first"), ["first", "id"], "left_semi")
    # a segment that occurs again can be the one in the other line, too
    t = t.selectExpr("*", "posexplode(segments) AS (i, segment)").where(f"({_segment_sql('segment')}) = first")
    t = t.selectExpr("*", f"length(array_join(slice(segments, 1, i), '{CUT}')) + IF(i > 0, 1, 0) AS at", "length(segment) AS size")
    cases = []
    for k, lo, beyond in _ranges(bands):
        listed = lambda rows: "array(" + ", ".join(f"named_struct('own', {own}, 'threshold', {k}, 'd', {d})" for own, d in rows) + ")"  # noqa: B023, E731
        asks = [(0, d) for d in range(k + 1)]
        cases.append(f"CASE WHEN n >= {lo} AND n < {beyond} THEN {listed([(1, 0), *asks])} WHEN n >= {lo - k} AND n < {lo} THEN {listed([(1, 0)])} ELSE {listed([])} END")
    t = t.selectExpr("*", f"inline(concat({', '.join(cases)}))").where("n - d >= size")
    return t.selectExpr(*lines.columns, "xxhash64(first, threshold, n - d) AS k", "own", "1 - own AS ask", "threshold", "n - d AS ends", "at", "size")


def within_sql(a: str, b: str, threshold: int) -> str:
    """True if arrays of characters a and b are at most ``threshold`` edits apart.

    The band of 2 * threshold + 1 diagonals of the edit matrix lies in one integer; its
    vertical steps are updated for a whole column at a time, and the distance is
    followed down the lowest diagonal, then along the last row.
    """
    k = threshold
    top, full = 2 * k, (1 << (2 * k + 1)) - 1
    match = " | ".join(f"CASE WHEN get({a}, i + {bit - k}) = get({b}, i) THEN {1 << bit} ELSE 0 END" for bit in range(2 * k + 1))
    d0 = "((((pm & z.vp) + z.vp) ^ z.vp) | pm | z.vn)"
    hp = f"(z.vn | (~(d0 | z.vp) & {full}))"
    hn = "(d0 & z.vp)"
    last_row = f"i >= size({a}) - {k}"
    step = f"""transform(array({match}), pm -> transform(array({d0} & {full}), d0 -> struct(
        ({hn} | (~(shiftright(d0, 1) | {hp}) & {full})) AS vp, (shiftright(d0, 1) & {hp}) AS vn,
        z.dist + CASE WHEN {last_row} THEN sign({hp} & z.h) - sign({hn} & z.h) ELSE 1 - shiftright(d0, {top}) END AS dist,
        CASE WHEN {last_row} THEN shiftright(z.h, 1) ELSE z.h END AS h))[0])[0]"""
    start = f"struct({full & ~((1 << k) - 1)} AS vp, 0 AS vn, {k} AS dist, {1 << (top - 1) if top else 0} AS h)"
    step = step.replace("z.dist + CASE", "int(z.dist + CASE").replace("END AS dist", "END) AS dist")
    return f"aggregate(sequence(0, size({b}) - 1), {start}, (z, i) -> {step}, z -> z.dist <= {k})"


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and line, for each line that is not empty."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return t.where("line <> ''")


def _met(keyed: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Of rows (k, id, sign, own, ask, ...), each line once in each bucket where lines meet, with
    the numbers of lines that file (n_own) and ask (n_ask). One exchange by k serves it all."""
    each = keyed.repartition("k").groupBy("k", "id", "sign", *more).agg(F.max("own").alias("own"), F.max("ask").alias("ask"))
    bucket = Window.partitionBy("k")
    sizes = {"n_own": F.sum("own").over(bucket), "n_ask": F.sum("ask").over(bucket), "lo": F.min("id").over(bucket), "hi": F.max("id").over(bucket)}
    return each.withColumns(sizes).where("n_own > 0 AND n_ask > 0 AND lo <> hi").drop("lo", "hi")


def _count_sql(letter: str) -> str:
    return f"(octet_length(line) - octet_length(replace(line, '{letter}', '')))"


def sign_sql() -> str:
    """Counts of ``LETTERS``, four bits each, and eight bits of the length."""
    counts = [f"shiftleft({_count_sql(c)} & 15, {4 * k})" for k, c in enumerate(LETTERS)]
    return "int(" + " | ".join([*counts, f"shiftleft(n & 255, {4 * len(LETTERS)})"]) + ")"


def crowd_sign_sql() -> str:
    """Counts of ``CROWD_LETTERS``, four bits each."""
    return " | ".join(f"shiftleft(bigint({_count_sql(c)} & 15), {4 * k})" for k, c in enumerate(CROWD_LETTERS))


def crowd_more_sql() -> str:
    """Counts of ``CROWD_OTHERS``, four bits each, and above them eight bits of the length."""
    counts = [f"shiftleft(bigint({_count_sql(c)} & 15), {4 * k})" for k, c in enumerate(CROWD_OTHERS)]
    return " | ".join([*counts, f"shiftleft(bigint(n & 255), {4 * len(CROWD_OTHERS)})"])


def _apart_sql(a: str, b: str, bits: int, at: int = 0) -> str:
    """How far the counts of so many bits from bit ``at`` on lie apart around their circle: no more than they differ."""
    part = lambda x: f"(shiftrightunsigned({x}, {at}) & {2**bits - 1})"
    return f"least(({part(a)} - {part(b)}) & {2**bits - 1}, ({part(b)} - {part(a)}) & {2**bits - 1})"


def _near_sql(threshold: int) -> str:
    """False if letters or lengths of signs differ by more than edits can change."""
    letters = " + ".join(_apart_sql("a_sign", "b_sign", 4, 4 * k) for k in range(len(LETTERS)))
    return f"{_apart_sql('a_sign', 'b_sign', 8, 4 * len(LETTERS))} <= {threshold} AND {letters} <= {2 * threshold}"


def _near_crowd_sql(threshold: int) -> str:
    return " + ".join(_apart_sql("a_sign", "b_sign", 4, 4 * k) for k in range(len(CROWD_LETTERS))) + f" <= {2 * threshold}"


def _count_sets(threshold: int) -> list[tuple[int, int]]:
    """The bits of each set of characters in ``sign`` and ``more``: two lines have the same in one set.
    Frequent characters and rare ones are dealt out evenly."""
    sets = 2 * threshold + 1
    dealt = lambda letters, j: sum(15 << (4 * i) for i in range(len(letters)) if j == (i % sets if i // sets % 2 == 0 else sets - 1 - i % sets))
    masks = [(dealt(CROWD_LETTERS, j), dealt(CROWD_OTHERS, j)) for j in range(sets)]
    return [(a - 2**64 if a >= 2**63 else a, b) for a, b in masks]


def _counted_pairs(met: DataFrame, most: int, threshold: int) -> DataFrame:
    """(a, b): lines that meet in a bucket of counts, most of them at most on its smaller side,
    and whose signs are near; each once in a first bucket, for the first set that they share."""
    cold = met.where(f"least(n_own, n_ask) <= {most}")
    sides = (("own", "a", "ask AS a_too"), ("ask", "b", "own AS b_too"))
    a, b = (cold.where(f"{side} = 1").selectExpr("k", *(["number"] if x == "a" else []), f"id AS {x}", f"sign AS {x}_sign", f"more AS {x}_more", too) for side, x, too in sides)
    x, y = "(a_sign ^ b_sign)", "(a_more ^ b_more)"
    differ = lambda z, n: f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {int('1' * n, 16)})"
    length = _apart_sql("a_more", "b_more", 8, 4 * len(CROWD_OTHERS))
    # an insertion or deletion changes one count only
    near = f"{differ(x, len(CROWD_LETTERS))} + {differ(y, len(CROWD_OTHERS))} + {length} <= {2 * threshold} AND {length} <= {threshold} AND {_near_crowd_sql(threshold)}"
    first = " AND ".join(f"(number <= {j} OR ({x} & {p}) <> 0 OR ({y} & {q}) <> 0)" for j, (p, q) in enumerate(_count_sets(threshold)))
    once = "(a < b OR a > b AND (a_too = 0 OR b_too = 0))"
    return a.join(b, "k").where(f"{once} AND {near} AND {first}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs(met: DataFrame, hot: int, near: str) -> DataFrame:
    """(a, b): lines that meet in a small bucket and whose signs are near."""
    cold = met.where(f"least(n_own, n_ask) <= {hot}")
    a, b = (cold.where(f"{side} = 1").select("k", F.col("id").alias(x), F.col("sign").alias(f"{x}_sign")) for side, x in (("own", "a"), ("ask", "b")))
    return a.join(b, "k").where("a <> b").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared_sql(low: str, high: str) -> str:
    """Length of what two strings begin with alike."""
    differs = f"array_position(transform(c.x, (v, i) -> NOT v <=> get(c.y, i)), true)"
    return f"transform(array(struct(split({low}, '') AS x, split({high}, '') AS y)), c -> CASE WHEN {differs} = 0 THEN size(c.x) ELSE int({differs}) - 1 END)[0]"


def _trimmed(rows: DataFrame) -> DataFrame:
    """Rows (k, own, rest, cuts, ...) without what all rests of a bucket begin with, then end
    with, and own_length made anew.

    ``cuts`` are the places in the rest where something was taken out. What goes must hold
    none of them, unless they lie alike in all of the bucket's rows.
    """
    for left in (True, False):
        key, places = ("rest", "cuts") if left else ("reverse(rest)", "reverse(transform(cuts, c -> length(rest) - c))")
        ends = rows.selectExpr("k", f"{key} AS text", f"{places} AS at").groupBy("k").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.min("at").alias("a"), F.max("at").alias("z"), F.min(F.get("at", F.lit(0))).alias("free"))
        ends = ends.select("k", F.expr(f"CASE WHEN a = z THEN {_shared_sql('low', 'high')} ELSE least(free, {_shared_sql('low', 'high')}) END").alias("same"))
        rest = "substr(rest, same + 1)" if left else "left(rest, length(rest) - same)"
        cuts = "transform(cuts, c -> greatest(0, c - same))" if left else "transform(cuts, c -> least(c, length(rest) - same))"
        rows = rows.join(ends, "k").withColumn("cuts", F.expr(cuts)).withColumn("rest", F.expr(rest)).drop("same")
    lengths = rows.where("own = 1").groupBy("k").agg(F.max(F.length("rest")).alias("own_length"))
    return rows.drop("own_length").join(lengths, "k")


def _cut_again(hot: DataFrame, bands: tuple) -> DataFrame:
    """The next keys of rows (k, id, sign, own, ask, long, threshold, own_length, rest, cuts):
    own_length is the length of the rests that are filed."""
    listed = lambda rows: "array(" + ", ".join("named_struct('files', {}, 'd', {}, 'number', {}, 'shift', {}, 'place', {})".format(*r) for r in rows) + ")"
    cases, none = [], f"slice({listed([(1, 0, 0, 0, -1)])}, 1, 0)"
    for threshold in sorted({k for _, k in bands}):
        # a row makes those keys only that fit its rest: how much longer than the filed ones it is, is known
        files = listed([(1, 0, i, 0, -1) for i in range(threshold + 1)])
        asks = " ".join(f"WHEN {d} THEN " + listed([(0, d, i, x, -1) for i in range(threshold + 1) for x in range(-threshold, threshold + 1) if abs(x) <= i and abs(d - x) <= threshold - i]) for d in range(threshold + 1))
        by_segment = f"concat(IF(own = 1, {files}, {none}), CASE IF(ask = 1, n - own_length, -1) {asks} ELSE {none} END)"
        # too short for segments of a character each: what differs at another place shares a character
        places = [(1, 0, 100 + x, 0, x) for x in range(threshold)], [(0, 0, 100 + x, 0, y) for x in range(threshold) for y in range(2 * threshold)]
        by_character = f"concat(IF(own = 1, {listed(places[0])}, {none}), IF(ask = 1, {listed(places[1])}, {none}))"
        fits = "x -> x.place < n AND own_length > x.number - 100"
        cases.append(f"WHEN {threshold} THEN IF(own_length > {threshold}, {by_segment}, filter({by_character}, {fits}))")
    t = hot.withColumn("n", F.length("rest")).selectExpr("*", f"inline(CASE threshold {' '.join(cases)} END)").withColumn("base", F.expr("int((n - d) div (threshold + 1))"))
    longer = "(threshold + 1 - (n - d) % (threshold + 1))"
    t = t.selectExpr("*", f"IF(place >= 0, place, number * base + greatest(0, number - {longer}) + shift) AS at", f"IF(place >= 0, 1, base + IF(number >= {longer}, 1, 0)) AS size")
    t = t.where("n > d AND size > 0 AND at >= 0 AND at + size <= n")
    inner = "transform(filter(cuts, c -> c > at AND c < at + size), c -> c - at)"
    moved = "transform(cuts, c -> CASE WHEN c <= at THEN c WHEN c >= at + size THEN c - size ELSE at END)"
    return t.selectExpr(f"xxhash64(k, number, substr(rest, at + 1, size), {inner}) AS k", "id", "sign", "files AS own", "1 - files AS ask", "long", "threshold", "own_length - size AS own_length", "concat(left(rest, at), substr(rest, at + size + 1)) AS rest", f"array_sort(concat({moved}, array(at))) AS cuts")


def _stars(crowd: DataFrame) -> DataFrame:
    """(a, b): links of crowded lines of which no more characters than the threshold are left.

    The gaps that a line's characters are left in are all that differs, whatever they are:
    two lines are linked if their gaps together, as sets with repetition, are no more than
    the threshold. That holds if they have enough gaps in common, so lines meet under each
    part of their gaps, and are linked to the one with the fewest characters, if that one
    is long enough to ask. What shares a character besides is found when it is taken out.
    """
    left = crowd.where("length(rest) <= threshold AND own_length <= threshold").withColumn("size", F.length("rest"))
    gaps = "CASE WHEN size = 0 THEN CAST(array() AS array<int>) ELSE transform(sequence(0, size - 1), j -> size(filter(cuts, c -> c <= j))) END"
    part = "explode(array_distinct(transform(sequence(0, shiftleft(1, size) - 1), x -> filter(gaps, (g, i) -> (shiftright(x, i) & 1) = 1)))) AS part"
    rows = left.selectExpr("k", "id", "long", "threshold", "size", f"{gaps} AS gaps").selectExpr("k", "id", "long", "threshold", "size", part)
    heads = rows.where("long").groupBy("k", "part").agg(F.min("size").alias("least"), F.min_by("id", F.struct("size", "id")).alias("b"))
    near = rows.join(heads, ["k", "part"]).where("id <> b AND size + least <= threshold + size(part)")
    return near.select(F.col("id").alias("a"), "b").distinct()


def _hot_links(texts: DataFrame, large: DataFrame, bands: tuple, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(candidate pairs, links) of the buckets that are too large for pairs, a table for each level:
    ``large`` has their rows (k, id, own, ask), ``texts`` the lines of these and others."""
    if large.isEmpty():
        return [], []
    threshold = max(k for _, k in bands)
    texts = texts.join(large.select("id").distinct(), "id", "left_semi").withColumns({"sign": F.expr(crowd_sign_sql()), "more": F.expr(crowd_more_sql())})
    texts = staged(texts, "line-hot-texts")
    sets = ", ".join(f"xxhash64(k, {j}, sign & {p}, more & {q})" for j, (p, q) in enumerate(_count_sets(threshold)))
    counted = large.join(texts.select("id", "sign", "more"), "id").selectExpr("k AS bucket", "id", "sign", "more", "own", "ask", f"posexplode(array({sets})) AS (number, k)")
    counted = staged(_met(counted, ("more", "number", "bucket")), "line-counted")
    pairs, stars = [staged(_counted_pairs(counted, CROWD * hot, threshold), "line-pairs")], []
    keys = staged(counted.where(f"least(n_own, n_ask) > {CROWD * hot}").select(F.col("bucket").alias("k"), "id").distinct(), "line-hot-keys")
    dropped(counted)
    if keys.isEmpty():
        return pairs, stars
    # the first keys again, now with what the segment leaves of the line; lines that met no crowd are left out
    texts = texts.join(keys.select("id").distinct(), "id", "left_semi")
    long = "CASE threshold " + " ".join(f"WHEN {k} THEN n >= {lo}" for k, lo, _ in _ranges(bands)) + " END AS long"
    few = texts.join(_by_content(texts, bands).where("NOT enough").select("id"), "id", "left_semi")
    rows = _equal_parts(few, bands).join(keys, ["k", "id"], "left_semi").unionByName(_content_rows(texts, keys, bands))
    rows = rows.selectExpr("k", "id", "sign", "own", "ask", long, "threshold", "ends - size AS own_length", "concat(left(line, at), substr(line, at + size + 1)) AS rest", "array(at) AS cuts")
    near = _near_crowd_sql(threshold)
    state = ("long", "threshold", "own_length", "rest", "cuts")
    while True:
        found = staged(_met(rows, state), "line-level")
        if found.isEmpty():
            return pairs, stars
        crowd = staged(_trimmed(found.where(f"least(n_own, n_ask) > {hot}").select("k", "id", "sign", "own", "ask", *state)), "line-crowd")
        stars.append(staged(_stars(crowd), "line-stars"))
        pairs.append(staged(_pairs(found, hot, near), "line-pairs"))
        dropped(found)
        rows = _cut_again(crowd, bands)


def _together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as a single scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.staged_at for t in tables])


def edit_links(docs: DataFrame, bands: tuple = BANDS, hot: int = HOT) -> DataFrame:
    """(a, b): 128-bit hashes of different lines within the longer one's threshold, enough of
    them to connect all that are (within small buckets, all)."""
    lines = text_lines(docs).select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("n")).where(f"n >= {bands[0][0] - bands[0][1]}")
    keyed = _first_keys(lines.withColumn("sign", F.expr(sign_sql())), bands)
    met = staged(_met(keyed), "line-keys")
    first = staged(_pairs(met, hot, _near_sql(max(k for _, k in bands))), "line-pairs")
    large = staged(met.where(f"least(n_own, n_ask) > {hot}").select("k", "id", "own", "ask"), "line-hot")
    dropped(met)
    # all texts that any later step reads are fetched once
    ids = lambda ends: ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id")))
    asked = staged(ids(first).union(large.select("id")).distinct(), "line-asked")
    found = lines.join(asked.hint("shuffle_hash"), "id", "left_semi").groupBy("id", "line").agg(F.first("n").alias("n"))
    found = staged(found, "line-found")
    pairs, stars = _hot_links(found, large, bands, hot)
    ends = _together([first, *pairs, *stars]).distinct()
    wanted = staged(ids(ends).distinct(), "line-wanted")
    counts = "array(" + ", ".join(f"{_count_sql(c)}" for c in MORE_LETTERS) + ") AS counts"
    texts = staged(found.join(wanted, "id", "left_semi").selectExpr("id", "line", "n", "md5(line) AS h", counts), "line-texts")
    a, b = ([F.col("id").alias(x), F.struct("line", "n", "h", "counts").alias(y)] for x, y in (("a", "p"), ("b", "q")))
    both = ends.join(texts.select(*a), "a").join(texts.select(*b), "b")
    threshold = threshold_sql("greatest(p.n, q.n)", bands)
    cases = " ".join(f"WHEN {k} THEN {within_sql('c.x', 'c.y', k)}" for k in sorted({k for _, k in bands}))
    # characters are bound once: inside the fold they would be split anew at each step
    near = f"transform(array(struct(split(p.line, '') AS x, split(q.line, '') AS y)), c -> CASE {threshold} {cases} ELSE false END)[0]"
    counted = f"aggregate(zip_with(p.counts, q.counts, (x, y) -> abs(x - y)), 0, (s, x) -> s + x) <= 2 * {threshold}"
    return both.where(f"abs(p.n - q.n) <= {threshold}").where(counted).where(near).selectExpr("p.h AS a", "q.h AS b")


def line_dedup(docs: DataFrame, bands: tuple = BANDS, hot: int = HOT) -> DataFrame:
    """doc_id, line_no, line_id (32 hex digits), class_id (that of the line kept) and kept of each line."""
    places = staged(text_lines(docs).select(F.monotonically_increasing_id().alias("place"), "doc_id", "line_no", F.md5("line").alias("line_id")), "line-places")
    # lines are numbered by one of their places; places and their number fit fixed-width sums
    nodes = staged(places.groupBy("line_id").agg(F.min("place").alias("node"), F.count("*").alias("n")), "line-nodes")
    links = staged(edit_links(docs, bands, hot), "line-links")
    number = lambda x: nodes.select(F.col("line_id").alias(x), F.col("node").alias(f"{x}_node"))
    edges = links.join(number("a"), "a").join(number("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    classes = components(edges).select("node", "root")
    # lines that stand alone are their class' head; the others look for it
    shared = nodes.join(classes, "node", "left").where("n > 1 OR root IS NOT NULL").select("line_id", F.coalesce("root", "node").alias("root"), "n")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_lines = shared.where(F.col("n") * PARTS > total).drop("n")  # fewer than PARTS rows
    rest = shared.where(F.col("n") * PARTS <= total).drop("n")
    common = places.join(F.broadcast(hot_lines), "line_id")
    others = places.join(F.broadcast(hot_lines.select("line_id")), "line_id", "left_anti").join(rest, "line_id", "left")
    named = staged(common.unionByName(others), "line-named")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "line_no", "place", "line_id")
    heads = named.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("head")).select("root", "head.place", F.col("head.line_id").alias("class_id"))
    heads = staged(heads.withColumnRenamed("place", "kept_place"), "line-heads")
    big = named.where("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") * PARTS > total).select("root")
    few = heads.join(F.broadcast(big), "root", "left_semi")  # fewer than PARTS rows
    first = named.join(F.broadcast(few), "root")
    second = named.join(F.broadcast(big), "root", "left_anti").join(heads, "root", "left")
    out = first.unionByName(second)
    return out.select("doc_id", "line_no", "line_id", F.coalesce("class_id", "line_id").alias("class_id"), (F.col("root").isNull() | (F.col("place") == F.col("kept_place"))).alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
