"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring characters (in classes that keep
letters apart, and the signs that markup, tables and noise are made of) and
repetitions of words.  Logarithmic counts, weighted by rarity, are projected on
the leading singular vectors of a labelled sample.  The sample's latent vectors
are broadcast; every text is compared with all of them, in blocks, and the
labels of the nearest are weighted by their cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices
from .substring import word_hashes

CLASSES = 64
#: Terms after the pairs: words that repeat the one before, words in all by powers of two, and such repeats per hundred words.
REPEATS, PAIRS = 24, CLASSES * CLASSES
TERMS = PAIRS + REPEATS
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4
BLOCK = 256
UNSURE = 0.5
#: Cosines that differ by less are ties.
SAME = 1e-7


@lru_cache(1)
def byte_classes() -> np.ndarray:
    """a-z apart; capitals, digits, blanks and bytes of other characters together; signs apart."""
    table = np.full(256, 60, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[ord("A") : ord("Z") + 1] = 26
    table[ord("0") : ord("9") + 1] = 27
    table[[9, 11, 12, 13, 32]] = 28
    table[10] = 29
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}"):
        table[ord(c)] = 30 + min(i, 29)
    table[ord("|")] = 61
    table[0xC0:] = 62
    table[0x80:0xC0] = 63
    return table


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts[text, term]."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = byte_classes()[data]
    pairs = kinds[:-1] * CLASSES + kinds[1:] + np.repeat(np.arange(len(raw)), sizes)[:-1] * PAIRS if len(data) else np.zeros(0, np.int64)
    if len(data):
        ends = np.cumsum(sizes)[sizes > 0][:-1] - 1  # a pair lies within one text
        inside = np.ones(len(pairs), bool)
        inside[ends] = False
        pairs = pairs[inside]
    out = np.zeros((len(raw), TERMS), np.float32)
    out[:, :PAIRS] = np.bincount(pairs, minlength=len(raw) * PAIRS).reshape(len(raw), PAIRS)
    split = [r.split() for r in raw]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    if counts.any():
        hashes = word_hashes(b" ".join(b" ".join(s) for s in split if s))
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        begins = np.cumsum(counts) - counts
        same[begins[(counts > 0)]] = False
        repeats = np.add.reduceat(same, begins[counts > 0], dtype=np.int64)
        held = np.flatnonzero(counts)
        out[held, PAIRS] = repeats
        share = np.minimum(100 * repeats // counts[held], 99)
        out[held, PAIRS + 1 + np.minimum(np.ceil(np.log2(share + 1)).astype(int), 7)] = np.where(share > 0, counts[held], 0)
    return out


def latent(counts: np.ndarray, used: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of texts; those of texts without known terms are zero."""
    x = np.log1p(counts[:, used].astype(np.float64)) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    z = x @ basis
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return np.round(np.where(norm > 1e-9, z / np.maximum(norm, 1e-9), 0), 9)  # alike whatever else is in the block


def fit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms that occur, their rarity, the leading right singular vectors by subspace iteration)."""
    used = np.flatnonzero(counts.any(0))
    counts, n = counts[:, used], len(counts)
    weights = np.log((1 + n) / (1 + (counts > 0).sum(0))) + 0.2
    x = np.log1p(counts.astype(np.float64)) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(RANK, n, len(used))
    q = np.linalg.qr(x.T @ np.random.default_rng(0).standard_normal((n, rank + 8)))[0]
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return used, weights, (q @ v.T)[:, :rank]


def vote(vectors: np.ndarray, neighbours: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Scores of unit vectors by the labels of the nearest unit vectors, weighted by a power of their cosines.

    All that are as near as the last of NEIGHBOURS vote, so no order matters.
    """
    out = np.full(len(vectors), UNSURE)
    k = min(NEIGHBOURS, len(neighbours))
    for a in range(0, len(vectors), BLOCK):
        cosines = vectors[a : a + BLOCK] @ neighbours.T
        last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        row, near = np.nonzero(cosines >= last - SAME)
        w = np.maximum(cosines[row, near], 0) ** SHARPNESS
        total, ones = (np.bincount(row, x, len(cosines)) for x in (w, w * labels[near]))
        out[a : a + BLOCK] = np.where(total > 0, ones / np.where(total > 0, total, 1), UNSURE)
    return np.round(np.clip(out, 0, 1), 9)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", 1 << 18):
        rows = [x.tobytes() for x in term_counts(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("quality"), pa.array(rows, pa.binary())], names=["place", "quality", "counts"])


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, labels) of the labelled ids with the least hashes, at most ``per_label`` of each label, in that order; of a repeated id the least text."""
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = own.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows
    once = texts.groupBy("place", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = once.mapInArrow(_features, "place int, quality int, counts binary").toLocalIterator()
    rows = sorted((r["place"], r["quality"], bytes(r["counts"])) for r in found)
    if not rows:
        return np.zeros((0, TERMS), np.float32), np.zeros(0)
    return np.stack([np.frombuffer(c, np.float32) for *_, c in rows]), np.array([q for _, q, _ in rows], float)


def score(docs: DataFrame, labels: DataFrame, *, per_label: int = 1500, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (doc_id, held_out, score) of documents (doc_id, text), one for each row; labels: (doc_id, quality 0 or 1).

    Learns from labels of documents that aren't held out (crc32 of the id mod 5
    is not 0), at most ``per_label`` of each label; a score is made from the
    whole text alone.  Texts without any term (null, empty, one character), and
    all texts where there are no labels, get UNSURE.  Neighbours that tie with
    the last all vote; the order of rows, in documents and labels, changes
    nothing.  Further columns are ignored unless ``keep`` names them; repeated
    rows give repeated rows.
    """
    counts, quality = sample(docs, labels, per_label)
    if len(counts):
        space = fit(counts)
        model = (space, latent(counts, *space), quality)
    else:
        model = None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * per_label vectors of RANK numbers
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 18):
            out = np.full(len(texts), UNSURE)
            if shared.value:
                space, near, quality = shared.value
                for k in range(0, len(texts), BLOCK):
                    out[k : k + BLOCK] = vote(latent(term_counts(texts[k : k + BLOCK]), *space), near, quality)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("held_out"), pa.array(out)], names=schema.names)

    return docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), *["text"] * ("text" not in keep)).mapInArrow(run, schema)
