"""Language identification by segmentation-marginalised unigrams.

A word's likelihood in a language is the sum, over all ways to segment it into
pieces of a fixed public vocabulary, of the product of the pieces'
probabilities in that language; a forward pass over the word computes it.  A
text's log likelihood is the sum over its words.  The probabilities are learned
by expectation-maximisation over the same lattices.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices

MARK = "▁"  # starts a word, in the vocabulary too
UNKNOWN = 0  # any character that is no piece
LONG_WORD = 32
ROUNDS = 3
FLOOR = 1e-7
LONG_SLICE = 1 << 16
CACHED_WORDS = 300_000
_RUNS = re.compile(r"[^\W\d_]+")  # of letters and of number signs other than digits
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters (general category L), lower-cased."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


class Pieces:
    """The vocabulary: pieces of letters by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        texts = {t.lower() for t in texts if (x := t.replace(MARK, "", 1)) == "" or x.isalpha()}
        self.ids = {t: i + 1 for i, t in enumerate(sorted(texts))}
        self.size = len(self.ids) + 1
        self.longest = max(map(len, self.ids))
        self.bits = (16 * self.size).bit_length()
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for t, i in self.ids.items():
            h = self._hash(t)
            at = int(self._slot(np.array([h], np.uint64))[0])
            while self.values[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = h, i

    @staticmethod
    def _hash(text: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in text:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of hashed strings, -1 for those that are no piece."""
        at = self._slot(keys)
        out, there = self.values[at], self.keys[at]
        open_ = np.flatnonzero((out >= 0) & (there != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            value = self.values[at[open_]]
            out[open_] = value
            open_ = open_[(value >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out

    def lattice(self, some: list[str]) -> np.ndarray:
        """ids[word, end, length]: the piece of ``length + 1`` characters that ends there, or -1 (words of any equal padding)."""
        marked = [MARK + w for w in some]
        width = max(map(len, marked))
        points = np.zeros((len(some), width), np.uint64)
        held = np.arange(width)[None, :] < np.fromiter(map(len, marked), np.int64, len(marked))[:, None]
        points[held] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((len(some), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * _BASE + points[:, j]
        deep = min(self.longest, width)
        ids, power = np.full((len(some), width, deep), -1, np.int32), 1
        for k in range(deep):
            power = power * int(_BASE) % 2**64
            ends = slice(k, width)
            own = prefix[:, k + 1 :] - prefix[:, : width - k] * np.uint64(power)
            ids[:, ends, k] = np.where(held[:, ends], self.find(own.ravel()).reshape(own.shape), -1)
        first = ids[:, :, 0]
        first[held & (first < 0)] = UNKNOWN
        return ids


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_length(some: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        groups.setdefault(len(w) // 3, []).append(i)
    for own in groups.values():
        for k in range(0, len(own), 4096):
            yield own[k : k + 4096]


def forward(ids: np.ndarray, p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha[word, position, language], likelihood[word, language]); p[language, piece + 1] with 0 first, for -1."""
    n, width, deep = ids.shape
    alpha = np.zeros((n, width + 1, p.shape[0]))
    alpha[:, 0] = 1
    flat = np.ascontiguousarray(p.T)
    for j in range(width):
        for k in range(min(deep, j + 1)):
            rows = np.flatnonzero(ids[:, j, k] >= 0)  # few, for long pieces
            if len(rows):
                alpha[rows, j + 1] += alpha[rows, j - k] * flat[ids[rows, j, k] + 1]
    return alpha, alpha[np.arange(n), lengths]


def _count_long(word: str, weight: float, p: np.ndarray, vocabulary: Pieces, total: np.ndarray) -> None:
    """Adds the expected pieces of a word of any length to ``total``: logarithms, and a lattice of LONG_SLICE ends at a time."""
    marked = MARK + word
    n = len(marked)

    def arcs(first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position after, position before, piece + 1, log probability) of all pieces that end in the slice, by end."""
        low = max(0, first - vocabulary.longest)  # what stands there is taken for a mark, but no piece reaches it unless it is one
        ids = vocabulary.lattice([marked[low + 1 : first + LONG_SLICE]])[0, first - low :]
        ends, lengths = np.nonzero(ids >= 0)
        piece = ids[ends, lengths] + 1
        return first + ends + 1, first + ends - lengths, piece, np.log(p[piece])

    def add(sums: array, at: int, x: float) -> None:
        y = sums[at]
        sums[at] = x if y == -inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))

    alpha, beta = array("d", [0.0]) + array("d", [-inf]) * n, array("d", [-inf]) * n + array("d", [0.0])
    for first in range(0, n, LONG_SLICE):
        after, before, _, q = arcs(first)
        for b, a, x in zip(after.tolist(), before.tolist(), q.tolist(), strict=True):
            add(alpha, b, alpha[a] + x)
    for first in reversed(range(0, n, LONG_SLICE)):
        after, before, piece, q = arcs(first)
        for b, a, x in zip(after[::-1].tolist(), before[::-1].tolist(), q[::-1].tolist(), strict=True):
            add(beta, a, beta[b] + x)
        np.add.at(total, piece, weight * np.exp(np.asarray(alpha)[before] + q + np.asarray(beta)[after] - alpha[n]))


def fit(counts: list[tuple[str, str, int]], path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, p[language, piece + 1]) from (language, word, count): expectation-maximisation from uniform pieces.

    Words may be of any length; a language without any count keeps uniform pieces.
    """
    vocabulary = pieces(path)
    names = sorted({c[0] for c in counts})
    p = np.full((len(names), vocabulary.size + 1), 1.0 / vocabulary.size)
    p[:, 0] = 0
    for _ in range(rounds if names else 0):
        total = np.zeros_like(p)
        for row, name in enumerate(names):
            own = [(w, c) for lang, w, c in counts if lang == name and len(w) <= LONG_WORD]
            for w, c in ((w, c) for lang, w, c in counts if lang == name and len(w) > LONG_WORD):
                _count_long(w, c, p[row], vocabulary, total[row])
            for part in _by_length([w for w, _ in own]):
                some, weight = [own[i][0] for i in part], np.array([own[i][1] for i in part], float)
                ids, lengths = vocabulary.lattice(some), np.array([len(w) + 1 for w in some])
                alpha, z = forward(ids, p[row : row + 1], lengths)
                alpha, z = alpha[:, :, 0], z[:, 0]
                beta = np.zeros_like(alpha)
                beta[np.arange(len(some)), lengths] = weight / z
                for j in range(ids.shape[1] - 1, -1, -1):
                    for k in range(min(ids.shape[2], j + 1)):
                        q = p[row][ids[:, j, k] + 1]
                        total[row] += np.bincount(ids[:, j, k] + 1, alpha[:, j - k] * q * beta[:, j + 1], p.shape[1])
                        beta[:, j - k] += q * beta[:, j + 1]
        total[:, 0] = 0
        total[total.sum(1) == 0] = 1
        total += FLOOR * total.sum(1, keepdims=True)
        total[:, 0] = 0
        p = total / total.sum(1, keepdims=True)
    return names, p


class Scorer:
    """Log likelihoods of words in every language, kept in a cache of bounded size."""

    def __init__(self, path: str, p: np.ndarray):
        self.vocabulary, self.p = pieces(path), p
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, p.shape[0]))

    def _long(self, word: str) -> np.ndarray:
        """A word of any length, rescaled at each character."""
        get, marked = self.vocabulary.ids.get, MARK + word
        deep = self.vocabulary.longest
        recent, scale = [np.ones(self.p.shape[0])], np.zeros(self.p.shape[0])
        for j in range(len(marked)):
            now = np.zeros(self.p.shape[0])
            for k in range(min(deep, j + 1)):
                i = get(marked[j - k : j + 1], UNKNOWN if k == 0 else -1)
                if i >= 0:
                    now += recent[-1 - k] * self.p[:, i + 1]
            recent = [x / now for x in recent[-deep:]] + [np.ones(self.p.shape[0])]
            scale += np.log(now)
        return scale

    def _learn(self, new: list[str]) -> None:
        need = len(self.rows) + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, len(self.table)), self.p.shape[0]))])
        at = len(self.rows)
        short = [w for w in new if len(w) <= LONG_WORD]
        for part in _by_length(short):
            some = [short[i] for i in part]
            ids = self.vocabulary.lattice(some)
            _, z = forward(ids, self.p, np.array([len(w) + 1 for w in some]))
            self.table[at : at + len(some)] = np.log(z)
            self.rows.update(zip(some, range(at, at + len(some)), strict=True))
            at += len(some)
        for w in new:
            if len(w) > LONG_WORD:
                self.table[at] = self._long(w)
                self.rows[w] = at
                at += 1

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods[text, language], words per text)."""
        found = [words(t) for t in texts]
        if len(self.rows) > CACHED_WORDS:
            self.rows.clear()
            self.table = np.zeros((1024, self.p.shape[0]))
        if new := set().union(*found).difference(self.rows):
            self._learn(list(new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.fromiter((r for f in found for r in map(self.rows.__getitem__, f)), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((1, self.p.shape[0])), np.cumsum(self.table[rows], axis=0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes], sizes


_scorers: dict[str, Scorer] = {}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter((lang, w) for lang, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True) for w in words(t))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])


def training_counts(docs: DataFrame, texts_per_language: int) -> list[tuple[str, str, int]]:
    """(language, word, count) of the texts with the least hashes of each language, all their words, in order.

    Bounded by the words of ``texts_per_language`` times the languages' texts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    picked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("r", F.row_number().over(picked)).where(F.col("r") <= texts_per_language).select("doc_id", "lang").distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most texts_per_language ids a language
    counted = texts.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return sorted((r["lang"], r["word"], r["n"]) for r in counted.toLocalIterator())


def identify(docs: DataFrame, vocabulary_path: str, *, texts_per_language: int = 200) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of documents (doc_id, text, lang), one for each row.

    Learns from texts and non-null languages of documents that aren't held out
    (crc32 of the id mod 5 is not 0): of each language all words of at most
    ``texts_per_language`` texts.  Predictions see the whole text alone.
    ``score`` is the language's posterior under equal priors.  Texts that are
    null or have no letter (number signs such as a half or a circled one are
    none) get ``und`` and 0, as do all if nothing can be learned; ties go to the
    first language by name; further columns are ignored.
    """
    names, p = fit(training_counts(docs, texts_per_language), vocabulary_path)
    p = p.astype(np.float64)
    key = f"{vocabulary_path}:{hash(p.tobytes())}"
    shared = docs.sparkSession.sparkContext.broadcast(p)  # languages times pieces
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(vocabulary_path, shared.value)
        scorer = _scorers[key]
        for batch, texts in slices(batches, "text", 1 << 20):
            if names:
                logs, sizes = scorer.score(texts)
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred = [names[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
                share = np.where(sizes > 0, share, 0.0)
            else:
                pred, share = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(share)], names=schema.names)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
