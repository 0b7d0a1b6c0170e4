"""Near duplicates by SimHash and anchor-point covering.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits.  Fingerprints
at four or fewer differing bits differ by at most one bit in some segment
(4 // 3 = 1).  The anchors of a segment are the code words of a covering code of
radius 1: a perfect Hamming code on its low 15 bits, all words on the others.
If x and y differ by at most one bit there, x's nearest anchor lies within 1 of
x and within 2 of y; so every fingerprint goes to each anchor within covering
radius plus threshold (15 or 16 of them a segment), and linked fingerprints meet
at an anchor.  There whole fingerprints are compared, each group for itself; a
group of more than GROUP fingerprints is cut into blocks, and each pair of its
blocks is a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
CODE_BITS = 15
SHIFTED_GROUP = 48
ROWS_AT_ONCE = 1 << 18
GROUP = 1 << 15
ANCHORS = 3 << 18  # at most: 2 ** 17 or 2 ** 18 code words a segment


def fingerprint(text: str) -> int:
    """SimHash of the text's four-word shingles, 0 if it has no words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    last = min(SHINGLE_WORDS, len(words)) - 1
    ends = (begins + sizes)[last:]
    count, ones = len(ends), np.zeros(64, np.int64)
    shingles = [line[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=False)]
    for k in range(0, count, 1 << 15):
        hashes = np.fromiter(map(xxh64_intdigest, shingles[k : k + (1 << 15)], repeat(SEED)), np.dtype("<u8"), min(1 << 15, count - k))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *further: str) -> DataFrame:
    """Rows (doc_id, fingerprint long, further columns) of documents (doc_id, text, further columns), one for each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.LongType()), *(docs.schema[c] for c in further)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 22):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(fingerprint, texts)), pa.int64()), *map(batch.column, further)], names=schema.names)

    return docs.select("doc_id", "text", *further).mapInArrow(run, schema)


def _syndrome(word: int) -> int:
    out = 0
    for i in range(CODE_BITS):
        if word >> i & 1:
            out ^= i + 1
    return out


def flips(width: int) -> list[list[int]]:
    """By syndrome of a segment: what to flip to reach each anchor at two or fewer bits."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(3):
        for at in combinations(range(width), weight):
            e = sum(1 << i for i in at)
            found[_syndrome(e)].append(e)
    return found


def anchors(fingerprint: Column) -> Column:
    """All anchors of a fingerprint, an array of longs that hold the segment and the code word."""
    parts = []
    for k, (first, width) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << i for i in range(CODE_BITS) if (i + 1) >> b & 1) for b in range(4)]
        syndrome = sum(((F.bit_count(segment.bitwiseAND(F.lit(m))) % 2) * (1 << b) for b, m in enumerate(masks)), F.lit(0))
        table = F.array(*(F.array(*(F.lit(e).cast("long") for e in row)) for row in flips(width)))
        base = segment.bitwiseXOR(F.lit(k << 22).cast("long"))
        parts.append(F.transform(F.element_at(table, syndrome + 1), base.bitwiseXOR))
    return F.concat(*parts)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, root) that join what the pairs join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def link_groups(anchor: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all prints at MOST_BITS or fewer within each run of equal anchors, a forest of them."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    small = np.repeat(sizes <= SHIFTED_GROUP, sizes)
    a, p = anchor[small], prints[small]
    for k in range(1, int(sizes[sizes <= SHIFTED_GROUP].max(initial=1))):
        near = np.flatnonzero((a[k:] == a[:-k]) & (np.bitwise_count(p[k:] ^ p[:-k]) <= MOST_BITS))
        left.append(p[:-k][near])
        right.append(p[k:][near])
    for s, n in zip(starts[sizes > SHIFTED_GROUP].tolist(), sizes[sizes > SHIFTED_GROUP].tolist(), strict=True):
        rest = prints[s : s + n]
        while len(rest):  # breadth first: what is reached leaves, so dense groups take few passes
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest ^ x) <= MOST_BITS
                if near.any():
                    new = rest[near]
                    left.append(np.full(len(new), x, np.uint64))
                    right.append(new)
                    front.extend(new)
                    rest = rest[~near]
    if not left:
        return []
    return _forest(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, fingerprint) that come sorted by anchor."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out(anchor: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if found := link_groups(anchor, prints.view(np.uint64)) if len(anchor) else []:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE and held[-1][0][-1] != held[0][0][0]:
            anchor, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            yield from out(anchor[:end], prints[:end])
            held, rows = [(anchor[end:], prints[end:])], len(anchor) - end
    if held:
        anchor, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from out(anchor, prints)


def place(classes: DataFrame, most: int = GROUP) -> DataFrame:
    """Rows (unit, fingerprint): the fingerprints that are to be compared with each other.

    A unit is an anchor, or a pair of blocks of the fingerprints at an anchor
    that has more than ``most`` of them.
    """
    placed = classes.select(F.explode(anchors(F.col("fingerprint"))).alias("anchor"), "fingerprint")
    large = stored(placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most), "large-anchors")
    blocks = large.select("anchor", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    both = placed.join(F.broadcast(blocks), "anchor", "left")  # at most ANCHORS rows
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own)
    pairs = F.transform(others, lambda x: F.shiftleft(F.least(x, own).cast("long"), 24) + F.shiftleft(F.greatest(x, own).cast("long"), 43))
    units = both.select(F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "anchor", "fingerprint")
    return units.select((F.col("anchor") + F.col("pair")).alias("unit"), "fingerprint")


def _named(classes: DataFrame) -> DataFrame:
    """Rows (fingerprint, root, least) of rows (fingerprint, least) of distinct fingerprints: the root of its component, and the least of all there."""
    links = place(classes).repartition("unit").sortWithinPartitions("unit").mapInArrow(_link, LINKS)
    linked = stored(classes.join(connected_components(links).withColumnsRenamed({"node": "fingerprint"}), "fingerprint"), "linked-classes")
    best = stored(linked.groupBy("root").agg(F.min("least").alias("best")), "least-of-components")  # a table, so that a large component can be split in the join
    named = linked.select("fingerprint", "root").join(best, "root").select("fingerprint", "root", "best")
    every = classes.join(named, "fingerprint", "left")
    return stored(every.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("best")).alias("least")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of documents (doc_id, text), one for each row.

    ``fingerprint``: 16 lowercase hex digits.  ``component_id``: the smallest
    doc_id among all documents that links of at most four differing bits reach,
    itself included.  Equal fingerprints form one class, so groups of copies are
    compared once however large they are.  A null or empty text has the
    fingerprint zero, linked like any other; null ids take no part in the
    minimum (a component of null ids alone has the id null); texts may be of any
    length; further columns are ignored; no documents give no rows.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    named = _named(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = prints.join(named.select("fingerprint", F.col("least").alias("component_id")), "fingerprint")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Rows (kept_id, kept_digest), one for each component of documents (doc_id, text, digest).

    The least (doc_id, digest) of the component's rows, null ids after all
    others; ``digest`` tells texts of the same id apart.
    """
    prints = stored(fingerprints(docs, "digest"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    named = _named(stored(prints.groupBy("fingerprint").agg(F.min(first).alias("least")), "classes"))
    return named.where(F.col("root") == F.col("fingerprint")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.digest").alias("kept_digest"))
