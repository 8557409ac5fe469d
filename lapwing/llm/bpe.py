"""BPE encoding and decoding.

Encoding backtracks over longest token matches: an Aho-Corasick automaton gives
the longest token at a position, and a token may follow another only if the two
are compatible, that is if merging their joint text by rank gives back exactly
the two. Wherever no compatible token fits, the last one is given up for its next
shorter prefix; a position that failed once is never tried again. So every word
takes linear time and the result is what the merges in rank order would give.
Decoding copies tokens out of one byte string by an offset table.

Words repeat, so the ids of recent chunks (runs between white space) are kept in
a dictionary of bounded size; it changes the speed only.

Defined results: a null text counts as empty and has no ids; an empty text gives
zero ids and the empty string. Further columns of the input pass through
``encode_column`` untouched.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import small_arrow_batches, table, text_or_empty

#: Chunks and words in each generation of a dictionary.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 100_000
CACHE_PAIRS = 300_000
LONGEST_CACHED = 48
#: Ids that decoding copies out at a time.
DECODE_BLOCK = 200_000
#: Neither letters, numbers nor white space to the tokenizer: a run of them is one piece, if nothing follows.
MARKS = string.punctuation
#: Below this code point, the regex module and the tokenizer agree on every character's class.
PLAIN_LIMIT = 0x530
_END = 0x4000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """Printable stand-ins for the 256 bytes: a printable Latin-1 character stands
    for itself, the others get the code points from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class _Missing(dict):
    """A dictionary that works out what it lacks.

    When it is full its entries become the old ones, which are asked before an entry
    is made anew; those of the generation before are dropped.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _After(dict):
    """For a token, whether each of those that stood after it is compatible; worked out when first asked."""

    __slots__ = ("bpe", "left")

    def __init__(self, bpe: WordBpe, left: int):
        self.bpe, self.left = bpe, left

    def __missing__(self, token: int) -> bool:
        bpe = self.bpe
        if bpe.known_pairs >= CACHE_PAIRS:
            bpe.known_pairs = 0
            for row in bpe.after:
                row.clear()
        bpe.known_pairs += 1
        known = self[token] = self.left < 0 or bpe._compatible(self.left, token, 1 << 40)
        return known


class WordBpe:
    """A word-level BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.word_pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        symbols = _byte_symbols()
        self.to_symbols = "".join(symbols)
        self.to_end = {s: chr(ord(s) + _END) for s in symbols}
        self._compile(model["merges"], symbols)
        n = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [""] * n
        for s, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = s
        self.token_bytes, self.token_offsets = _offset_table([f"{s} ".encode() for s in names])
        self.id_bytes, self.id_offsets = _offset_table([f"{i} ".encode() for i in range(n)])
        self.words = _Missing(self._encode_word, CACHE_WORDS)
        self.chunks = _Missing(self._encode_chunk, CACHE_CHUNKS)
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.size))]
        self._pair_table()

    def _compile(self, merges: list, symbols: list[str]) -> None:
        text: dict[int, str] = {}
        for s in symbols:
            text[self.vocab[s]] = s
            text[self.vocab[s + self.suffix]] = chr(ord(s) + _END)
        n = max(self.vocab.values()) + 1
        self.first, self.second, self.rank = [-1] * n, [-1] * n, [-1] * n  # the halves of a merged token and its rank
        self.merged: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[left << 17 | right] = rank
            if both not in text:
                text[both] = text[left] + text[right]
                self.first[both], self.second[both], self.rank[both] = left, right, rank
        self.size = [0] * (max(text) + 1)
        for i, t in text.items():
            self.size[i] = len(t)
        usable: set[int] = set()
        for i in sorted(text, key=self.rank.__getitem__):
            if self.rank[i] < 0:
                usable.add(i)
            elif self.first[i] in usable and self.second[i] in usable and self._compatible(self.first[i], self.second[i], self.rank[i]):
                usable.add(i)
        self.by_text = {text[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_text.items():
            if len(s) > 1:
                self.automaton.add_word(s, (i, len(s) - 1))
        self.base = {s: i for s, i in self.by_text.items() if len(s) == 1}
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, i in self.by_text.items():
            self.shorter[i] = next((self.by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.by_text), -1)

    def _compatible(self, left: int, right: int, below: int) -> bool:
        """True if no merge of rank under ``below`` joins text across the border.

        Undo merges on both sides from the last to the first: at each moment the
        two symbols at the border must not merge earlier than the one undone last.
        """
        rank, first, second, merged, limit = self.rank, self.first, self.second, self.merged, below
        made_left, made_right = rank[left], rank[right]
        while True:
            if merged.get(left << 17 | right, limit) < limit:
                return False
            if made_left > made_right:
                # the left one was made later: of equal merges the left comes first in the text
                limit, left = made_left, second[left]
                made_left = rank[left]
            elif made_right >= 0:
                limit, right = made_right + 1, first[right]
                made_right = rank[right]
            else:
                return True

    def _pair_table(self) -> None:
        self.after = [_After(self, left) for left in range(len(self.size))]
        self.after.append(_After(self, -1))  # what a word may begin with
        self.known_pairs = 0

    def _encode_symbols(self, s: str) -> list[int]:
        n, at, out, dead = len(s), 0, [], ()
        size, shorter, after = self.size, self.shorter, self.after
        longest = list(map(self.base.__getitem__, s))
        for end, (token, before) in self.automaton.iter(s):  # of the matches that begin at a place, the longest comes last
            longest[end - before] = token
        token, fits = longest[0], after[-1]
        while True:
            while token >= 0:
                if fits[token]:
                    end = at + size[token]
                    if end not in dead:
                        break
                token = shorter[token]
            else:
                if dead:
                    dead.add(at)
                else:
                    dead = {at}
                token = out.pop()
                at -= size[token]
                token, fits = shorter[token], after[out[-1] if out else -1]
                continue
            out.append(token)
            if end == n:
                return out
            at, token, fits = end, longest[end], after[token]

    def _encode_word(self, word: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, as little-endian 32-bit integers."""
        if not (word.isascii() and word.isprintable()):  # those stand for themselves
            word = charmap_decode(word.encode(), "strict", self.to_symbols)[0]
        word = word[:-1] + self.to_end[word[-1]]
        whole = self.by_text.get(word)
        return self.raw[whole] if whole is not None else b"".join(map(self.raw.__getitem__, self._encode_symbols(word)))

    def _encode_shown(self, shown: str) -> bytes:
        return b"".join([self.raw[i] for i in self._encode_symbols(shown[:-1] + self.to_end[shown[-1]])])

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, which no normalisation reaches across."""
        low = chunk.lower()
        word = low.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            if len(word) < len(low):  # marks after a word are a piece of their own
                return self.chunks[word] + self.chunks[low[len(word) :]]
            return self._encode_word(word) if word == chunk else self.chunks[word]
        if not word and low == chunk:
            return self._encode_word(chunk)
        # only the tokenizer knows how its own Unicode version orders recent marks
        if not chunk.isascii() and max(chunk) < chr(PLAIN_LIMIT) and not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        if chunk.isascii() or max(chunk) < chr(PLAIN_LIMIT):
            words = self.words
            return b"".join([words[w] for w in self.word_pattern.findall("".join([c.lower() for c in chunk]) if "Σ" in chunk else chunk.lower())])
        normal = self.library.normalizer.normalize_str(chunk)
        return b"".join([self._encode_shown(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])

    def _encode_plain(self, text: str) -> bytes:
        runs = text.split()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
            runs = regex.split(r"[^\S\x1c-\x1f]+", text)
            runs = [r for r in runs if r]
        return b"".join(map(self.chunks.__getitem__, runs))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit integers."""
        if "<|" in text and self.special_pattern and self.special_pattern.search(text):
            parts = self.special_pattern.split(text)
            raw = b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._encode_plain(p) for p in parts)
        else:
            raw = self._encode_plain(text)
        return np.frombuffer(raw, "<u4")

    def decode_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of ids, token by token with one space between, in bounded blocks."""
        return _blocks(ids, self.token_bytes, self.token_offsets)

    def decode(self, ids) -> str:
        return b"".join(self.decode_blocks(np.asarray(ids, "<u4"))).decode()

    def decimal_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        return _blocks(ids, self.id_bytes, self.id_offsets)


def _offset_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)


def _blocks(ids: np.ndarray, blob: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Copy ``blob[offsets[i]:offsets[i + 1]]`` for each id; the last space is left out."""
    for k in range(0, len(ids), DECODE_BLOCK):
        part = ids[k : k + DECODE_BLOCK]
        begin = offsets[part]
        sizes = offsets[part + 1] - begin
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(begin - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        out = blob[at].tobytes()
        yield out[:-1] if k + DECODE_BLOCK >= len(ids) else out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each Python worker and vocabulary."""
    return WordBpe(path)


def encode_column(df: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``, the ids of ``text`` as array<int>; other columns stay."""
    path = path or default_vocabulary()
    small_arrow_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in fields]
    schema = df.select(*[F.col(f"`{n}`") for n in names]).withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], col], names=[*names, out])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def decode_column(df: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of ``ids``; null ids count as none."""
    path = path or default_vocabulary()
    small_arrow_batches(df.sparkSession)
    names = [n for n in df.columns if n != out]
    schema = df.select(*[F.col(f"`{n}`") for n in names]).withColumn(out, F.lit(None).cast("string")).schema

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            texts = [bpe.decode(i or []) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, out])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass.

    The ids and the decoded text of a document never leave the worker; they are
    hashed in blocks, so that memory follows the longest text only.
    """
    path = path or default_vocabulary()
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids))
                for blocks, to in ((bpe.decimal_blocks(ids), ids_sha), (bpe.decode_blocks(ids), decoded_sha)):
                    h = hashlib.sha256()
                    for x in blocks:
                        h.update(x)
                    to.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
