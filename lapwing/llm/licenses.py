"""License scans by a trained paragraph classifier, in DataFrame and SQL functions.

A paragraph is a run of lines with letters or digits; comment marks are no words. It
is read as a whole, so hard-wrapped notices are found, and line by line, so a licence
line in the middle of prose is. A reading is a set of word n-grams of one to three
words. A sparse softmax regression over the licence families, "unknown" and "none" is
fitted on sentences filled with the licences' names, on their notices, and on sentences
that are no licences: the L1 penalty leaves few n-grams with weights, a second fit sets
them, and a temperature set on sentences that were not trained on gives a prediction the
confidence it deserves. A prediction that is not sure enough, and one of the class
"unknown", is of an unknown licence. Comparison with the family's names and notices then
confirms a prediction: half of some template's three-word runs must occur.

An n-gram without a weight adds nothing, so a text is passed over unread if it lacks
every word of ``anchors``: from each n-gram with weights, the word that is rarest in
the other sentences. That loses nothing but "none". Everything is worked out in the
text's own row; nothing is shuffled. The model is one row, bounded by the fixed texts,
and is broadcast.

Defined results: a null or empty text has no licences; an empty table gives an empty
result; repeated rows, and rows that share a doc_id or have none, get the result of
their own text each. A paragraph names a confirmed family once, whatever the number of
its lines that do.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import table
from lapwing.llm.license_texts import CALIBRATION, EVERYDAY, NAMES, NOTICES, OTHERS, SENTENCES

SURE, CONFIRM = 0.6, 0.5
#: Penalty by which most n-grams lose their weights.
L1 = 3e-4
NONE, UNKNOWN = "none", "unknown"
CLASSES = [*dict.fromkeys([*NAMES, *NOTICES]), NONE]
#: Repetitions are possessive: a line may be long, and none of it is read twice.
WORD = r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"
_WORD = regex.compile(WORD)
_WORD_SQL = WORD.replace("\\", "\\\\")
#: Lines without letters or digits part paragraphs.
_PARTS_SQL = r"\\n(?:[^\\p{L}\\p{N}\\n]*+(?:\\n|\\z))++"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(text: str) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}


def training_texts() -> list[tuple[str, str]]:
    rows = [(s.format(n), f) for f, names in NAMES.items() for n in names for s in SENTENCES]
    rows += [(t, f) for f, texts in NOTICES.items() for t in texts for _ in range(4)]
    for f, texts in NOTICES.items():  # a wrapped notice's lines, and its first and last half
        for t in texts:
            w = t.split()
            rows += [(" ".join(w[: len(w) // 2]), f), (" ".join(w[len(w) // 2 :]), f)] * (len(w) > 12)
    halves = [" ".join(t.split()[len(t.split()) // 2 :]) for t in OTHERS]
    return rows + [(t, NONE) for t in [*OTHERS, *halves] for _ in range(6)] + [("", NONE)] * 20


def calibration_texts() -> list[tuple[str, str]]:
    rows = [(s.format(n), f) for f, names in NAMES.items() for n in names for s in CALIBRATION]
    return rows + [(f"{a[:-1]}, and {b[0].lower()}{b[1:]}", NONE) for a, b in zip(OTHERS, OTHERS[7:] + OTHERS[:7], strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def features(grams: list[set[str]], index: dict[str, int]) -> np.ndarray:
    """A row for each set of n-grams: 1 over the root of the number of known ones, for each."""
    x = np.zeros((len(grams), len(index)))
    for row, g in zip(x, grams, strict=True):
        known = [index[k] for k in g if k in index]
        if known:
            row[known] = 1.0 / np.sqrt(len(known))
    return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int, l1: float = 0.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax regression by accelerated proximal gradient steps;
    each class counts the same."""
    target = np.eye(len(CLASSES))[y]
    share = 1.0 / np.maximum(1, np.bincount(y, minlength=len(CLASSES)))[y]
    share = (share / share.sum())[:, None]
    w, b = np.zeros((x.shape[1], len(CLASSES))), np.zeros(len(CLASSES))
    v, rate = w, 2.0
    for k in range(rounds):
        d = share * (_softmax(x @ v + b) - target)
        new = v - rate * (x.T @ d + l2 * v)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        b = b - rate * d.sum(0)
        v, w = new + k / (k + 3) * (new - w), new
    return w, b


def _speaks(gram: str) -> bool:
    """False for n-grams of everyday words and numbers only, and for single words that the
    other sentences have too: such a word speaks through its neighbours."""
    w = gram.split()
    if len(w) == 1 and w[0] in _ordinary():
        return False
    return not all(x in EVERYDAY or x.replace(".", "").isdigit() for x in w)


@lru_cache(maxsize=1)
def _ordinary() -> dict[str, int]:
    """How many of the other sentences have a word."""
    found: dict[str, int] = {}
    for t in OTHERS:
        for k in set(words(t)):
            found[k] = found.get(k, 0) + 1
    return found


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The n-grams with weights, the weights and the offsets, both over the temperature."""
    rows = training_texts()
    grams, y = [ngrams(t) for t, _ in rows], np.array([CLASSES.index(f) for _, f in rows])
    seen: dict[str, int] = {}
    for g in grams:
        for k in g:
            seen[k] = seen.get(k, 0) + 1
    every = sorted(k for k, n in seen.items() if n > 1 and _speaks(k))
    w, _ = fit(features(grams, {k: i for i, k in enumerate(every)}), y, 150, l1=L1)
    kept = [k for k, row in zip(every, np.abs(w).max(1), strict=True) if row > 0]
    index = {k: i for i, k in enumerate(kept)}
    w, b = fit(features(grams, index), y, 300, l2=1e-4)
    b[CLASSES.index(NONE)] = max(b[CLASSES.index(NONE)], b.max())  # a text without known n-grams is none
    held = calibration_texts()
    z, at = features([ngrams(t) for t, _ in held], index) @ w + b, [CLASSES.index(f) for _, f in held]
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(_softmax(t * z)[range(len(at)), at] + 1e-12).sum())
    return kept, heat * w, heat * b


def predict(text: str) -> tuple[str, float]:
    """The family of a text, as the query's SQL finds it, and its probability."""
    kept, w, b = trained()
    p = _softmax(features([ngrams(text)], {k: i for i, k in enumerate(kept)}) @ w + b)[0]
    best = CLASSES[int(p.argmax())]
    return (best if best == NONE or p.max() >= SURE else UNKNOWN), float(p.max())


def anchors() -> list[str]:
    """Of each n-gram that can speak for a licence, the word that is rarest in the other
    sentences. The offset of "none" and the n-grams left out can't speak for one."""
    kept, w, _ = trained()
    none = CLASSES.index(NONE)
    can = [g for g, row in zip(kept, w, strict=True) if np.delete(row, none).max() > row[none]]
    content = [[k for k in g.split() if k not in EVERYDAY and not k.replace(".", "").isdigit()] for g in can]
    return sorted({min(ks, key=lambda k: (_ordinary().get(k, 0), -len(k), k)) for ks in content})


def templates() -> list[list[str]]:
    """For each class, runs of three words (or all, if fewer) of its names and notices, joined by lines."""
    out = []
    for f in CLASSES:
        texts = [*NAMES.get(f, []), *NOTICES.get(f, [])] if f not in (NONE, UNKNOWN) else []
        runs = set()
        for t in texts:
            w = words(t)
            w = w[1:] if w[0] in ("the", "a") else w
            if w == ["mit"] or w == ["isc"]:  # a word of other uses alone: with one that announces a licence
                runs |= {f"under {w[0]}", f"license {w[0]}", f"{w[0]} licence", f"{w[0]} lizenz", f"licence {w[0]}", f"licencia {w[0]}", f"license-identifier {w[0]}"}
                continue
            n = min(3, len(w))
            runs.add("\n".join(sorted({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})))
        out.append(sorted(runs))
    return out


def _model(spark: SparkSession) -> DataFrame:
    kept, w, b = trained()
    row = (kept, [r.tolist() for r in w], b.tolist(), anchors(), [[t.split("\n") for t in f] for f in templates()])
    return spark.createDataFrame([row], "grams array<string>, w array<array<double>>, b array<double>, anchors array<string>, templates array<array<array<string>>>")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _reading_sql(text: str) -> str:
    """Struct (best, p, confirmed) of a text: its class, the probability, the comparison."""
    grams = "array_distinct(concat(ws, transform(slice(ws, 2, size(ws)), (x, i) -> concat_ws(' ', get(ws, i), x)), transform(slice(ws, 3, size(ws)), (x, i) -> concat_ws(' ', get(ws, i), get(ws, i + 1), x))))"
    known = "transform(array_intersect(gs, m.grams), g -> int(array_position(m.grams, g)) - 1)"
    z = f"transform(sequence(0, {len(CLASSES) - 1}), c -> get(m.b, c) + aggregate(ks, 0D, (s, k) -> s + get(get(m.w, k), c)) / sqrt(greatest(1, size(ks))))"
    at = "int(array_position(zs, array_max(zs))) - 1"
    confirmed = f"exists(get(m.templates, a), t -> size(array_intersect(t, gs)) >= {CONFIRM} * size(t))"
    p = "round(1D / aggregate(zs, 0D, (s, v) -> s + exp(v - array_max(zs))), 6)"
    read = _let(z, "zs", _let(at, "a", f"struct(a AS best, {p} AS p, {confirmed} AS confirmed)"))
    body = _let(known, "ks", f"CASE WHEN size(ks) = 0 THEN struct({len(CLASSES) - 1} AS best, 1D AS p, false AS confirmed) ELSE {read} END")
    return _let(f"regexp_extract_all(lower({text}), '{_WORD_SQL}', 0)", "ws", _let(grams, "gs", body))


def readings(docs: DataFrame) -> DataFrame:
    """doc_id and paragraphs (number, families with their probability, unknown), of those
    that are not "none": families are the confirmed ones of the whole and of its lines, and
    unknown says that a line is of a licence though none is confirmed."""
    none = len(CLASSES) - 1
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    t = t.join(F.broadcast(_model(docs.sparkSession).selectExpr("struct(*) AS m")))
    speaks = lambda x: f"arrays_overlap(regexp_extract_all(lower({x}), '{_WORD_SQL}', 0), m.anchors)"
    parts = f"filter(transform(split(t, '{_PARTS_SQL}', -1), (x, i) -> struct(i AS number, x AS x)), x -> {speaks('x.x')})"
    lines = f"transform(filter(split(x.x, '\\n'), l -> {speaks('l')}), l -> {_reading_sql('l')})"
    names = "array(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
    sure = f"filter(rs, r -> r.confirmed AND r.p >= {SURE} AND r.best < {none})"
    families = f"array_sort(array_distinct(transform({sure}, r -> get({names}, r.best))))"
    doubted = f"exists(ls, r -> r.best < {none})"
    # the whole is read where it has more lines than one
    whole = f"CASE WHEN contains(x.x, '\\n') THEN array({_reading_sql('x.x')}) ELSE array() END"
    of_part = _let(lines, "ls", _let(f"concat(ls, {whole})", "rs", _let(families, "fs", f"struct(x.number AS number, fs AS families, array_max(transform(filter(rs, r -> r.best < {none}), r -> r.p)) AS probability, size(fs) = 0 AND {doubted} AS unknown)")))
    found = f"filter(transform({parts}, x -> {of_part}), p -> p.unknown OR size(p.families) > 0)"
    empty = "CAST(array() AS array<struct<number:int,families:array<string>,probability:double,unknown:boolean>>)"
    return t.selectExpr("doc_id", f"CASE WHEN {speaks('t')} THEN {found} ELSE {empty} END AS paragraphs")


def scan_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, number, families, probability, unknown: a row for each paragraph of a licence."""
    return readings(docs).selectExpr("doc_id", "inline(paragraphs)")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, families (confirmed ones, sorted, comma-joined), n_confirmed (families of
    paragraphs) and n_unknown (paragraphs) of each document."""
    return readings(docs).selectExpr(
        "doc_id",
        "array_join(array_sort(array_distinct(flatten(transform(paragraphs, p -> p.families)))), ',') AS families",
        "aggregate(paragraphs, 0L, (s, p) -> s + size(p.families)) AS n_confirmed",
        "CAST(size(filter(paragraphs, p -> p.unknown)) AS LONG) AS n_unknown",
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
