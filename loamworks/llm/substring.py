"""Removal of long passages that repeat, by prefix-partitioned suffix trees.

A window is 35 consecutive words.  A word goes if a window that covers it occurs
anywhere else.  The suffixes that are indexed start at anchors: in each window
the run of eight words with the least hash, the same place in equal windows, so
equal windows always meet at equal anchors (about one word in fifteen is one).

1.  Every text gives its digest and its anchors (hash, place, and how far the
    windows that it stands for reach to its left and right).
2.  Anchors whose hash occurs once in all texts are dropped.  Copies of a text
    take part once; each text that has a copy goes as a whole.  Only numbers of
    texts and digests meet for that, never the texts.
3.  The anchors' eight words are the prefix that deals suffixes into groups.  A
    prefix that is too frequent for one group's memory is lengthened to all 35
    words of each window; such a subtree is a single node, so counting its
    leaves is enough, and that is aggregated before the shuffle.  (Lengths in
    between would deal the same windows out again and find nothing more.)
4.  In each group the suffixes are sorted; their common prefixes give the
    subtree's internal nodes.  Among the suffixes below a node, the words to the
    left are treated alike.  Common words to the left and right of 35 or more
    are a maximal repeat.
5.  Spans go back to their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

WINDOW = 35
PREFIX = 8
SPAN = WINDOW - PREFIX + 1
GROUP_ROWS = 50_000  # some tens of megabytes
EMPTY_SHA = hashlib.sha256(b"").digest()

_BYTE = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(line: bytes) -> np.ndarray:
    """A 64-bit hash of each word of words that one space separates."""
    data = np.frombuffer(line + b" ", np.uint8)
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, np.uint64))
    return _mixed(np.add.reduceat(_BYTE[data] * powers[inside], starts))


def find_anchors(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' word hashes, end to end: (text, hash, place in it, words to its left, words to its right) of each anchor.

    Left and right (with the anchor's own words) are what the windows need for
    which the anchor has the least hash.
    """
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none, none
    grams = words
    for k, n in ((1, 1), (2, 2), (4, 4)):
        grams = grams[:-n] + grams[n:] * (_ODD ** np.uint64(k))
    grams = _mixed(grams)
    least, at = grams, np.arange(len(grams))
    reach = 1
    while reach < SPAN:  # the first least of ``reach`` in a row
        more = min(reach, SPAN - reach)
        left = least[:-more] <= least[more:]
        least, at = np.where(left, least[:-more], least[more:]), np.where(left, at[:-more], at[more:])
        reach += more
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - WINDOW + 1, 0)
    firsts = np.cumsum(windows) - windows
    if not windows.any():
        return none, none, none, none, none
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(int(windows.sum())) - np.repeat(firsts, windows) + begins[text]
    owner = at[start]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(owner)]]) - 1
    place = owner[new]
    return text[new], grams[place].view(np.int64), place - begins[text[new]], place - start[new], WINDOW - (place - start[last])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))


def _index(docs: DataFrame) -> DataFrame:
    """``docs`` with the text packed, digests of its words and its anchors."""
    columns = [c for c in docs.columns if c != "text"]
    own = [("_uid", T.LongType()), ("_n", T.LongType()), ("_digest", T.BinaryType()), ("_packed", T.BinaryType()), ("_hashes", T.ArrayType(T.LongType())), ("_places", T.ArrayType(T.LongType())), ("_again", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, t) for n, t in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        uid, zip_ = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(3).compress
        for batch, texts in slices(batches, "text", 1 << 19):
            raw = [t.encode() for t in texts]
            split = [r.split() for r in raw]
            lines = [b" ".join(w) for w in split]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            full = b" ".join(x for x in lines if x)
            text, hashes, place, left, right = find_anchors(word_hashes(full) if full else np.zeros(0, np.uint64), sizes)
            _, inverse, counts = np.unique(np.stack([text, hashes]), axis=1, return_inverse=True, return_counts=True) if len(text) else (None, np.zeros(0, int), np.zeros(0, int))
            again = (counts[inverse.ravel()] > 1).astype(np.int64)
            per_text = np.bincount(text, minlength=len(texts))
            packed = place << 16 | left << 8 | right
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(np.arange(uid, uid + n)), pa.array(sizes), pa.array([hashlib.sha256(x).digest() for x in lines], pa.binary()), pa.array([zip_(r) if there else None for r, there in zip(raw, batch.column("text").is_valid().to_pylist(), strict=True)], pa.binary()), _lists(hashes, per_text), _lists(packed, per_text), _lists(again, per_text)],
                names=[f.name for f in schema],
            )
            uid += n

    return stored(docs.select(*columns, "text").mapInArrow(run, schema), "substring-index")


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    for packed in batch.column("_packed"):
        yield unzip(packed.as_py()).split()


SUFFIXES = T.StructType([T.StructField("hash", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("place", T.LongType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])
WINDOWS = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("uid", T.LongType()), T.StructField("start", T.LongType())])
SPANS = T.StructType([T.StructField("uid", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ROWS_OUT = 4096


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def _suffixes(group_rows: int):
    """The suffixes at anchors whose prefix isn't too frequent, with the words to their left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for words, uid, anchors in zip(_texts(batch), batch.column("_uid").to_pylist(), batch.column("_anchors").to_pylist(), strict=True):
                    for a in anchors:
                        if a["n"] <= group_rows:
                            place, left, right = a["place"] >> 16, a["place"] >> 8 & 255, a["place"] & 255
                            yield a["hash"], uid, place, b" ".join(words[place - left : place]), b" ".join(words[place : place + right])

        yield from _batches(rows(), SUFFIXES)

    return run


def _windows(group_rows: int):
    """The windows at anchors whose prefix is too frequent, with all their words as prefix (its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for words, uid, anchors in zip(_texts(batch), batch.column("_uid").to_pylist(), batch.column("_anchors").to_pylist(), strict=True):
                    for a in anchors:
                        if a["n"] > group_rows:
                            place, left, right = a["place"] >> 16, a["place"] >> 8 & 255, a["place"] & 255
                            for start in range(place - left, place + right - WINDOW + 1):
                                yield hashlib.sha256(b" ".join(words[start : start + WINDOW])).digest()[:16], uid, start

        yield from _batches(rows(), WINDOWS)

    return run


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _neighbours(keys: list[list[bytes]]) -> tuple[list[int], list[int]]:
    """(order, common words of each and the next in that order)."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return order, [_common(keys[a], keys[b]) for a, b in zip(order, order[1:], strict=False)]


def nodes(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """The internal nodes (first leaf, last leaf, depth) of the tree whose neighbouring leaves have these common depths."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*depths, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            yield first, i, deep
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def maximal_repeats(group: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Spans (uid, start, end) of 35 or more words that occur elsewhere in the group (uid, place, left, right).

    Equal suffixes with equal words to their left are one leaf: all of it repeats.
    """
    leaves: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for uid, place, left, right in group:
        leaves.setdefault((left, right), []).append((uid, place))
    lefts, rights = ([k[i].split() for k in leaves] for i in (0, 1))
    lefts = [x[::-1] for x in lefts]
    held = list(leaves.values())
    found: dict[int, set[tuple[int, int]]] = {i: {(len(lefts[i]), len(rights[i]))} for i, m in enumerate(held) if len(m) > 1}
    whole = set(found)
    order, depths = _neighbours(rights)
    longest = max(map(len, lefts))
    for first, last, depth in nodes(depths):
        below = order[first : last + 1]
        if depth + longest < WINDOW or whole.issuperset(below):
            continue
        inner, common = _neighbours([lefts[i] for i in below])
        for k, i in enumerate(inner):
            left = max(common[k - 1] if k else 0, common[k] if k < len(common) else 0)
            if left + depth >= WINDOW and below[i] not in whole:
                found.setdefault(below[i], set()).add((left, depth))
    for i, spans in found.items():
        for uid, place in held[i]:
            for left, depth in spans:
                yield uid, place - left, place + depth


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes that come sorted by hash."""

    def rows() -> Iterator[tuple]:
        key, group = None, []
        for batch in batches:
            for h, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != key:
                    if len(group) > 1:
                        yield from maximal_repeats(group)
                    key, group = h, []
                group.append(tuple(rest))
        if len(group) > 1:
            yield from maximal_repeats(group)

    yield from _batches(rows(), SPANS)


def _finish(batches: Iterator[pa.RecordBatch], columns: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    """The columns, n_words, n_removed, kept_sha256 and the text of rows with their spans."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    names = [*columns, *["text"] * with_text, "n_words", "n_removed", "kept_sha256"]
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            counts, removed, texts, shas = batch.column("_n").to_pylist(), [], [], []
            for n, digest, packed, copied, spans in zip(counts, *(batch.column(c).to_pylist() for c in ("_digest", "_packed", "_copied", "_spans")), strict=True):
                if copied and n >= WINDOW:
                    gone, line, digest = n, b"", EMPTY_SHA
                elif spans:
                    words, kept, at = unzip(packed).split(), [], 0
                    for start, end in sorted((x["start"], x["end"]) for x in spans):
                        kept += words[at:start]
                        at = max(at, end)
                    kept += words[at:]
                    gone, line = n - len(kept), b" ".join(kept)
                    digest = hashlib.sha256(line).digest()
                else:
                    gone, line = 0, unzip(packed) if with_text and packed is not None else None
                removed.append(gone)
                shas.append(digest.hex())
                texts.append(None if line is None else line.decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *[pa.array(texts, pa.string())] * with_text, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], names=names)


def remove_repeats(docs: DataFrame, *, with_text: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``docs`` (with a column text) with n_words, n_removed and kept_sha256, and the text that is left.

    A word of a text goes if one of the 35-word windows that cover it also
    starts at any other place of any text, the same text included; windows are
    judged on the input.  Texts that lose nothing stay as they are; of others
    the words that are left are joined by one space.  Without ``with_text`` the
    text is left out.  One row for each row, repeated rows too (as copies of
    each other they lose all their words if they have 35 or more).  A null text
    has no words and stays null; texts may be of any length; further columns
    come along, null or not, but for names of the new ones, which are replaced.
    ``group_rows``: how many suffixes one subtree may hold.
    """
    new = ["n_words", "n_removed", "kept_sha256"]
    carried = [c for c in docs.columns if c not in (*new, "text")]
    columns = [f"own_{i}" for i in range(len(carried))]  # so that no name clashes
    index = _index(docs.select(*(docs[f"`{c}`"].alias(o) for c, o in zip(carried, columns, strict=True)), "text"))
    digests = index.select("_uid", "_digest")
    several = stored(digests.groupBy("_digest").agg(F.min("_uid").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_first"), "copied-texts")
    copies = stored(digests.join(several, "_digest").select("_uid", (F.col("_uid") == F.col("_first")).alias("_first")), "copies")  # tables, so that a text with many copies can be split
    anchors = index.select("_uid", F.xxhash64("_digest").alias("d"), F.explode(F.arrays_zip("_hashes", "_places", "_again")).alias("a"))
    flat = anchors.select("_uid", "d", F.col("a._hashes").alias("hash"), F.col("a._places").alias("place"), F.col("a._again").alias("again"))
    counted = flat.groupBy("hash").agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("again").alias("again"))
    repeated = stored(counted.where("d0 <> d1 or again > 0").select("hash", "n"), "repeated-prefixes")  # as a table, a frequent one can be split in the join
    places = flat.select("_uid", "hash", "place").join(repeated, "hash").groupBy("_uid").agg(F.collect_list(F.struct("hash", "place", "n")).alias("_anchors"))
    once = places.join(copies.where("NOT _first"), "_uid", "left_anti")
    held = stored(index.select("_uid", "_packed").join(once.hint("shuffle_hash"), "_uid"), "substring-candidates")

    suffixes = held.mapInArrow(_suffixes(group_rows), SUFFIXES)
    spans = suffixes.repartition("hash").sortWithinPartitions("hash").mapInArrow(_repeats, SPANS)
    windows = held.where(F.exists("_anchors", lambda a: a["n"] > group_rows)).mapInArrow(_windows(group_rows), WINDOWS)
    frequent = stored(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    wide = windows.join(frequent, "window").select("uid", "start", (F.col("start") + WINDOW).alias("end"))
    found = spans.union(wide).select(F.col("uid").alias("_uid"), F.struct("start", "end").alias("span"), F.lit(False).alias("copied"))
    known = found.union(copies.select("_uid", F.lit(None).cast(found.schema["span"].dataType).alias("span"), F.lit(True).alias("copied")))
    by_text = known.groupBy("_uid").agg(F.collect_set("span").alias("_spans"), F.max("copied").alias("_copied"))

    schema = T.StructType([*(index.schema[c] for c in columns), *[T.StructField("text", T.StringType())] * with_text, *(T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    joined = index.select(*columns, "_uid", "_n", "_digest", "_packed").join(by_text.hint("shuffle_hash"), "_uid", "left")
    out = joined.mapInArrow(lambda batches: _finish(batches, columns, with_text), schema)
    back = dict(zip(carried, columns, strict=True))
    kept = [c for c in docs.columns if c in back or c == "text" and with_text]
    return out.select(*(F.col(back.get(c, c)).alias(c) for c in kept), *new)


#: DuckDB SQL for the digests of what remove_repeats leaves, over the table documents: windows by doubling rows of words.
SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS MATERIALIZED (
  SELECT r, unnest(w) AS w1, unnest(range(len(w))) AS i FROM texts
), two AS (SELECT r, i, w1, w1 || ' ' || lead(w1) OVER (PARTITION BY r ORDER BY i) AS w2 FROM words
), four AS (SELECT r, i, w1, w2, w2 || ' ' || lead(w2, 2) OVER (PARTITION BY r ORDER BY i) AS w4 FROM two
), eight AS (SELECT r, i, w1, w2, w4 || ' ' || lead(w4, 4) OVER (PARTITION BY r ORDER BY i) AS w8 FROM four
), sixteen AS (SELECT r, i, w1, w2, w8 || ' ' || lead(w8, 8) OVER (PARTITION BY r ORDER BY i) AS w16 FROM eight
), windows AS (
  SELECT r, i, w16 || ' ' || lead(w16, 16) OVER own || ' ' || lead(w2, 32) OVER own || ' ' || lead(w1, 34) OVER own AS w35
  FROM sixteen WINDOW own AS (PARTITION BY r ORDER BY i)
), repeated AS (SELECT w35 FROM windows WHERE w35 IS NOT NULL GROUP BY w35 HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (w35)
), kept AS (SELECT r, count(*) AS n, string_agg(w1, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
