"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words counts the subsequences of three characters they share, with
up to two characters in between, and runs of four; each skipped character halves a
subsequence's weight, so an insult with inserted characters still lies close to the
insult. Runs of single characters are read as one word ("i d i o t"), and words over
``PIECE`` characters as overlapping pieces. The kernel of two sentences is the sum over
their pairs of words.

A linear SVM is trained on labelled sentences: those of texts labelled toxic against
those of the others, by their Nyström features (kernel to the landmarks, whitened).
Landmarks are words of the labelled texts, ranked by how far their frequencies in the
two classes lie apart, which serves rare languages too. A toxic text has harmless
sentences as well, so after the first fit only the worst part of each toxic text stays
positive, and the SVM is fitted again. As the kernel is an inner product of explicit
counts, the decision function becomes one table of weights of the landmarks'
subsequences, and the score of a run of words the sum of its words' scores.

A text is judged by its worst word, its worst short and longer stretch of words, and its
mean, which a logistic curve fitted on the labelled training texts turns into a
probability. A word counts where it first stands in the text, whatever the text's length.

Labels are read only for rows with crc32(doc_id) mod 5 other than 0, and of these a
sample of at most ``SAMPLE`` texts of either class (the smallest hashes of doc_id).
All words and sentences of the sampled texts are used. Where a class has no labelled
text, every score is 0.

Defined results: a null or empty text has no words and gets the score of a text whose
stretches all count nothing; an empty table gives an empty result; repeated rows get
the same result each, and rows that share a doc_id are scored by their own texts. In
training, a doc_id with several labels counts once for each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.bpe import _Missing
from lapwing.llm.common import small_arrow_batches, staged, table, text_or_empty

#: Labelled texts of each class, landmarks of each class.
SAMPLE, LANDMARKS = 1000, 160
#: Words of a training sentence at most, and of the stretches a text is judged by.
SPANS = (24, 96)
CACHE_WORDS, CACHE_VECTORS = 200_000, 40_000
#: Sentences that the SVM reads at a time.
BLOCK = 8192
PIECE = 40
#: Characters of a subsequence, counted from its first; each further character of its span halves the weight.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4), (0, 1, 2, 3))
_WEIGHTS = [0.5 ** (p[-1] + 1 - len(p)) for p in PATTERNS]
_WEIGHTED = list(zip(PATTERNS, _WEIGHTS, strict=True))
_STRIP = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_SINGLES = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
#: Fits after the first one, and the part of a toxic text that stays positive.
ROUNDS, WORST = 3, 0.25
PENALTY = 0.0003
#: What a word must score to count at all: a long text's many harmless words must not add up.
MARGIN = 0.3


def units(text: str) -> list[str]:
    """Distinct words of a text in order: lower case, three and more single characters in
    a row joined. A word counts where it first stands: saying it again makes no text worse."""
    low = text.lower()
    if _SINGLES.search(low):
        low = _SINGLES.sub(lambda m: "".join(m[0].split()), low)
    return list(dict.fromkeys(low.split()))


def plain(word: str) -> str:
    return word.strip(_STRIP)


def pieces(word: str) -> list[str]:
    """The word itself, or overlapping pieces of a long one."""
    n = len(word)
    return [word] if n <= PIECE else [word[k : k + PIECE] for k in range(0, n - PIECE // 2, PIECE // 2)]


def sentences(words: list[str]) -> list[list[str]]:
    """Runs of words up to one that ends a sentence, at most ``SPANS[0]`` long."""
    out, at = [], 0
    for k, w in enumerate(words, 1):
        if k - at == SPANS[0] or w[-1] in ".!?":
            out.append(words[at:k])
            at = k
    return [*out, words[at:]] if at < len(words) else out


def subsequences(word: str) -> list[tuple[str, float]]:
    out = []
    w = f"^{word}$"
    for p, weight in _WEIGHTED:
        out += [(s, weight) for s in map("".join, zip(*[w[k:] for k in p]))]  # noqa: B905
    return out


def _norm(length: int) -> float:
    return sum(max(0, length + 2 - p[-1]) * x * x for p, x in _WEIGHTED) ** 0.5 or 1.0


class Kernel:
    """Explicit counts of the landmarks' subsequences, and their whitened projection."""

    def __init__(self, landmarks: list[str]):
        self.index: dict[str, int] = {}
        for w in landmarks:
            for s, _ in subsequences(w):
                self.index.setdefault(s, len(self.index))
        base = np.array([self.counts(w) for w in landmarks])
        values, vectors = np.linalg.eigh(base @ base.T)
        good = values > 1e-6 * values[-1]
        #: Maps counts to Nyström features.
        self.project = (base.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)

    def counts(self, word: str) -> np.ndarray:
        """A word's counts over its norm: the inner product of two words' is their kernel."""
        x = np.zeros(len(self.index))
        for s, weight in subsequences(word):
            k = self.index.get(s)
            if k is not None:
                x[k] += weight
        return x / _norm(len(word))

    def features(self, word: str) -> np.ndarray:
        """Nyström features of a word; those of a long one's pieces, added."""
        out = np.zeros(self.project.shape[1], np.float32)
        for p in pieces(plain(word)):
            known = [(k, weight) for s, weight in subsequences(p) if (k := self.index.get(s)) is not None]
            if known and len(p) > 2:
                out += np.array([v for _, v in known], np.float32) @ self.project[[k for k, _ in known]] / _norm(len(p))
        return out

    def sentences(self, found: list[list[str]], known: dict[str, np.ndarray]) -> np.ndarray:
        """Nyström features of sentences: their words' features, added. ``known`` is a cache."""
        out = np.zeros((len(found), self.project.shape[1]), np.float32)
        for row, words in zip(out, found, strict=True):
            for w in words:
                row += known[w]
        return out


class WordModel:
    """Scores words by a table of subsequence weights, and texts by their stretches."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.tables = {n: {s: v for s, v in weights.items() if len(s) == n} for n in {len(p) for p in PATTERNS}}
        self.norms = [_norm(n) for n in range(PIECE + 1)]
        self.known = _Missing(self._score, CACHE_WORDS)
        self.cache = _Missing(self.word, CACHE_WORDS)

    def word(self, word: str) -> float:
        return self.known[word.strip(_STRIP)]

    def _score(self, w: str) -> float:
        n = len(w)
        if n < 3:
            return 0.0
        if n > PIECE:
            return sum(map(self._score, pieces(w)))
        w = f"^{w}$"
        tails = [w, w[1:], w[2:], w[3:], w[4:]]
        total = 0.0
        for p, weight in _WEIGHTED:
            found = map(self.tables[len(p)].get, map("".join, zip(*[tails[k] for k in p])))  # noqa: B905
            total += weight * sum(filter(None, found))
        return total / self.norms[n]

    def text(self, text: str) -> tuple[float, ...]:
        """What a text's words score over ``MARGIN``: the worst word, the worst short and
        long stretch, and the mean of a long one."""
        over = np.maximum(np.fromiter(map(self.cache.__getitem__, units(text)), np.float64) - MARGIN, 0.0)
        if not len(over):
            return 0.0, 0.0, 0.0, 0.0
        sums = np.concatenate([[0.0], np.cumsum(over)])
        worst = [float((sums[n:] - sums[:-n]).max()) if len(over) >= n else float(sums[-1]) for n in SPANS]
        return float(over.max()), *worst, float(sums[-1]) * SPANS[1] / max(SPANS[1], len(over))


def fit_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """A linear SVM with squared hinge loss by Newton steps; the last weight is the offset."""
    size = x.shape[1] + 1
    keep = np.full(size, penalty)
    keep[-1] = 1e-6
    w = np.zeros(size) if start is None else start
    for _ in range(12):
        left, right = np.diag(keep), np.zeros(size)
        for at in range(0, len(x), BLOCK):  # rows that count nothing are left out block by block
            part = slice(at, at + BLOCK)
            inside = (c[part] > 0) & (y[part] * (x[part] @ w[:-1] + w[-1]) < 1)
            xi = np.hstack([x[part][inside], np.ones((inside.sum(), 1))])
            ci = c[part][inside]
            left = left + (xi * ci[:, None]).T @ xi
            right += xi.T @ (ci * y[part][inside])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-4 * np.abs(new).max():
            return new
        w = new
    return w


def fit_sentences(x: np.ndarray, toxic: np.ndarray, text: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of sentences' features. ``toxic`` and ``text`` tell each sentence's label and text.

    Each class counts one half, each toxic text as much as the others; after the first
    fit, a toxic text's worst sentences stay positive and the others are left out.
    """
    y = np.where(toxic, 1.0, -1.0)
    used, w = np.ones(len(y), bool), None
    for _ in range(1 + ROUNDS):
        share = 1.0 / np.maximum(1, np.bincount(text[used], minlength=text.max() + 1))
        c = np.where(toxic, share[text], 1.0)
        c = np.where(used, np.where(toxic, c / c[toxic & used].sum(), c / c[~toxic].sum()) / 2, 0.0)
        w = fit_svm(x, y, c, penalty, w)
        scores = x @ w[:-1]
        order = np.lexsort((-scores, text))
        rank = np.empty(len(y), np.int64)
        begin = np.searchsorted(text[order], text[order])
        rank[order] = np.arange(len(y)) - begin
        size = np.bincount(text, minlength=text.max() + 1)[text]
        used = ~toxic | (rank < np.maximum(1, np.ceil(WORST * size)))
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, toxic, text) of a bounded sample of labelled rows that are not held out."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    ids = ids.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct().withColumn("h", F.xxhash64("id"))
    picked = ids.where("toxic = 1").orderBy("h", "id").limit(sample).union(ids.where("toxic = 0").orderBy("h", "id").limit(sample)).select("id", "toxic")
    # at most 2 * sample rows
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(picked), "id").select("id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[WordModel | None, np.ndarray]:
    """The word model and the weights of the logistic curve over texts' scores."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    rows = staged(training_rows(docs, labels, sample), "toxic-rows")

    def words(batches):
        for b in batches:
            for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = sorted({q for w in units(text) for q in pieces(plain(w)) if len(q) > 2})
                found.append("")  # counts the texts
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([toxic] * len(found), pa.int32())], names=["word", "toxic"])

    tally = staged(rows.mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine")), "toxic-words")
    totals = tally.where("word = ''").collect()
    bad, fine = (totals[0]["bad"], totals[0]["fine"]) if totals else (0, 0)
    if not bad or not fine:
        return None, np.zeros(5)
    # how many texts a word sets apart, by the logarithm of its frequencies' ratio
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("fine") + 0.5) / (fine + 1))
    ranked = tally.where("word <> ''").withColumn("gain", ratio * F.when(ratio > 0, F.col("bad")).otherwise(F.col("fine")))
    top = ranked.where("gain > 0").orderBy(F.desc("gain"), "word").limit(LANDMARKS).collect()
    common = ranked.where("gain <= 0").orderBy(F.desc("fine"), "word").limit(LANDMARKS).collect()
    landmarks = list(dict.fromkeys(r["word"] for r in [*top, *common]))
    if not landmarks:
        return None, np.zeros(5)
    kernel = Kernel(landmarks)

    def features(batches):
        known = _Missing(kernel.features, CACHE_VECTORS)
        for b in batches:
            for doc, toxic, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = kernel.sentences(sentences(units(text)), known)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([toxic], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["id", "toxic", "x"])

    made = staged(rows.mapInArrow(features, "id long, toxic int, x binary"), "toxic-sentences")
    size = kernel.project.shape[1]
    n = made.agg(F.sum(F.octet_length("x"))).first()[0] // (4 * size)
    if not n:
        return None, np.zeros(5)
    x, toxic, of, at = np.empty((n, size), np.float32), np.zeros(n, bool), np.zeros(n, np.int64), 0
    texts: dict[tuple, int] = {}
    for r in made.toLocalIterator():  # a partition at a time: the driver holds the features once
        more = np.frombuffer(r["x"], np.float32).reshape(-1, size)
        x[at : at + len(more)], toxic[at : at + len(more)] = more, r["toxic"] > 0
        of[at : at + len(more)] = texts.setdefault((r["id"], r["toxic"]), len(texts))
        at += len(more)
    w = fit_sentences(x, toxic, of)
    del x
    flat = kernel.project @ w[:-1]
    weights = {s: float(flat[k]) for s, k in kernel.index.items()}

    def scored(batches):
        model = WordModel(weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([model.text(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "raw"])

    seen = rows.mapInArrow(scored, "toxic int, raw array<double>").collect()
    return WordModel(weights), fit_logistic(np.array([r["raw"] for r in seen]), np.array([float(r["toxic"]) for r in seen]))


def fit_logistic(raw: np.ndarray, y: np.ndarray, decay: float = 0.01) -> np.ndarray:
    """Weights of a logistic curve by Newton steps; the last one is the offset. The rarer
    class is weighed by the root of the classes' ratio."""
    x = np.hstack([raw, np.ones((len(raw), 1))])
    c = np.where(y > 0, max(1.0, y.sum()) ** -0.5, max(1.0, (1 - y).sum()) ** -0.5)
    c *= len(y) / c.sum()
    keep = np.array([decay * len(y)] * raw.shape[1] + [1e-6 * len(y)])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (c * (y - p)) - keep * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probabilities(raw: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw @ curve[:-1] + curve[-1], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    model, curve = train(docs, labels, sample)
    weights = model.weights if model else None

    def run(batches):
        mine = WordModel(weights) if weights else None
        for b in batches:
            ids = b.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            p = probabilities(np.array([mine.text(t) for t in b.column(1).to_pylist()]), curve) if mine else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
