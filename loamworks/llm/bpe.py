"""Byte-level BPE, encoding and decoding.

Pre-tokenisation runs without a regular expression.  Each code point gets a
class from a table; each class is a transition function on the ten states of a
small automaton.  The functions reachable by composition form a finite monoid,
so a text becomes an array of monoid elements and an associative prefix scan
(blocked, vectorised over blocks) gives the state at every position at once.
Token starts are then a table lookup of neighbouring states and classes.  The
resulting slices go through a bounded cache of merged pieces; pieces that are
not in it are merged together, one pair of each piece at a time, in arrays.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

# Classes of code points.
LETTER, LETTER_STMD, LETTER_RV, LETTER_E, LETTER_L, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK = range(10)
CLASSES = 10
# States: what the token that holds the last code point is so far.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_SPACE, AT_BLANK, AT_APOSTROPHE, SUFFIX_DONE, SUFFIX_RV, SUFFIX_L = range(10)
STATES = 10
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

NO_PAIR = np.int32(2**31 - 1)
CACHED_PIECES = 1_000_000
CACHED_IDS = 8_000_000
LONG_PIECE = 32
SHORT_PIECE = 15
#: By length: which of a short piece's 16 bytes are its own.
_KEPT_BYTES = np.array([[255 * (i < n) for i in range(16)] for n in range(SHORT_PIECE + 1)], np.uint8).view("<u8")
#: Decoded at once, and one text more.
DECODED_BYTES = 1 << 24


def step(state: int, kind: int) -> int:
    """The automaton: the state after a code point of class ``kind``."""
    if kind <= LETTER_L:
        if state == AT_APOSTROPHE:
            return {LETTER_STMD: SUFFIX_DONE, LETTER_RV: SUFFIX_RV, LETTER_L: SUFFIX_L}.get(kind, IN_LETTERS)
        if (state, kind) in ((SUFFIX_RV, LETTER_E), (SUFFIX_L, LETTER_L)):
            return SUFFIX_DONE
        return IN_LETTERS
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == APOSTROPHE:
        return IN_OTHERS if state in (IN_OTHERS, AT_SPACE, AT_APOSTROPHE) else AT_APOSTROPHE
    return {OTHER: IN_OTHERS, SPACE: AT_SPACE, BLANK: AT_BLANK}[kind]


# What a state and the class after it say about a token start between them.
NO, YES, IF_NO_SUFFIX, IF_LAST_BLANK = range(4)


def boundary(state: int, kind: int) -> int:
    if state == START:
        return YES
    if kind <= LETTER_L:
        if state in (IN_LETTERS, AT_SPACE, SUFFIX_RV, SUFFIX_L):
            return NO
        if state == AT_APOSTROPHE:
            return NO if kind == LETTER_STMD else IF_NO_SUFFIX if kind in (LETTER_RV, LETTER_L) else YES
        return YES
    if kind == NUMBER:
        return NO if state in (IN_NUMBERS, AT_SPACE) else YES
    if kind in (OTHER, APOSTROPHE):
        return NO if state in (IN_OTHERS, AT_SPACE, AT_APOSTROPHE) else YES
    return IF_LAST_BLANK if state in (AT_SPACE, AT_BLANK) else YES


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    try:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        letters, numbers = regex.findall(r"\p{L}", every), regex.findall(r"\p{N}", every)
    except ImportError:
        kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(0x110000)]
        letters, numbers = ([c for c, k in kinds if k == x] for x in "LN")
    table = np.full(0x110000, OTHER, np.uint8)
    table[list(map(ord, letters))] = LETTER
    table[list(map(ord, numbers))] = NUMBER
    table[WHITE_SPACE] = BLANK
    for chars, kind in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("e", LETTER_E), ("l", LETTER_L), ("'", APOSTROPHE), (" ", SPACE)):
        table[[ord(c) for c in chars]] = kind
    return table


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """(compose, apply): compose[f * n + g] is "f, then g"; apply[f * STATES + s] is f's value at s.

    Elements 0..9 are the classes' functions; 10..19 the same at the first code
    point of a text, where what came before has no say.
    """
    found = [tuple(step(s, k) for s in range(STATES)) for k in range(CLASSES)]
    found += [(step(START, k),) * STATES for k in range(CLASSES)]
    index = {f: i for i, f in reversed(list(enumerate(found)))}
    at = 0
    while at < len(found):  # closed under composition with the generators from the right
        for g in found[: 2 * CLASSES]:
            f = tuple(g[x] for x in found[at])
            if f not in index:
                index[f] = len(found)
                found.append(f)
        at += 1
    n = len(found)
    compose = np.array([[index[tuple(g[x] for x in f)] for g in found] for f in found], np.int32)
    return compose.ravel(), np.array(found, np.int32).ravel()


@lru_cache(1)
def boundary_table() -> np.ndarray:
    return np.array([[boundary(s, k) for k in range(CLASSES)] for s in range(STATES)], np.uint8).ravel()


def scan(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """The state after each element: an inclusive prefix scan under composition, from START."""
    compose, apply = monoid()
    n, size = len(functions), int(len(compose) ** 0.5)
    if n <= block:
        states, s = np.empty(n, np.int32), START
        for i, f in enumerate(functions.tolist()):
            s = states[i] = apply[f * STATES + s]
        return states
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.int32)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for k in range(1, block):  # within all blocks at once
        np.take(compose, grid[k - 1] * size + grid[k], out=grid[k])
    carry = np.concatenate([[START], scan(grid[-1][:-1], block)]) if rows > 1 else np.array([START])  # across blocks
    return np.take(apply, grid * STATES + carry[None, :].astype(np.int32)).T.reshape(-1)[:n]


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; ``firsts``: positions of the first code point of each text."""
    kinds = np.take(class_table(), points)
    functions = kinds.astype(np.int32)
    functions[firsts] += CLASSES
    states = scan(functions)
    before = np.empty_like(states)
    before[0] = START
    before[1:] = states[:-1]
    before[firsts] = START
    verdict = np.take(boundary_table(), before * CLASSES + kinds)
    starts = verdict == YES
    odd = np.flatnonzero(verdict >= IF_NO_SUFFIX)
    if len(odd):
        last = np.zeros(len(points), bool)  # of its text
        last[firsts[1:] - 1] = True
        last[-1] = True
        after = np.minimum(odd + 1, len(points) - 1)
        more = ~last[odd]
        blank = verdict[odd] == IF_LAST_BLANK
        starts[odd] = np.where(blank, more & (kinds[after] < SPACE), ~(more & (states[after] == SUFFIX_DONE)))
    return starts


class Vocabulary:
    """Ranks, the pairs that merge, and each token's bytes."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None):
        """``merges``: the pairs that merge, if not all whose bytes are a token."""
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pieces = [b""] * self.size
        for k, v in ranks.items():
            pieces[v] = k
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        pairs = merges if merges is not None else [(t[:i], t[i:]) for t in ranks for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        found = [(ranks[a], ranks[b], ranks[a + b]) for a, b in pairs]
        self.merged = {a << 20 | b: r for a, b, r in found}
        self.bits = max(12, (4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_PAIR, np.int32)
        keys = np.array([(a << 20) | b for a, b, _ in found], np.int64)
        for k, h, (_, _, r) in zip(keys.tolist(), self._slot(keys).tolist(), found, strict=True):
            while self.keys[h] != -1:
                h = (h + 1) & ((1 << self.bits) - 1)
            self.keys[h], self.values[h] = k, r

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines "base64 of the bytes, rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NO_PAIR where there is none (negative ids never merge)."""
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NO_PAIR)
        open_ = np.flatnonzero((there != keys) & (there != -1) & (keys != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length, in n log n steps."""
        get, n = self.merged.get, len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []  # rank, place, the two ids

        def meet(i: int, j: int) -> None:
            if (r := get(key := ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, key))

        for i in range(n - 1):
            meet(i, i + 1)
        while heap:
            r, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 20 | ids[j] != key:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                meet(i, after[i])
            if before[i] >= 0:
                meet(before[i], i)
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece) of pieces of at most LONG_PIECE bytes."""
        count, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        ids = np.full((count, width + 1), -1, np.int32)
        held = np.arange(width + 1)[None, :] < lengths[:, None]
        ids[held] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        done = np.full((count, width), -1, np.int32)
        rows = np.arange(count)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            on = best != NO_PAIR
            if not on.all():
                done[rows[~on], : ids.shape[1] - 1] = ids[~on, :-1]
                ids, ranks, rows, at, best = ids[on], ranks[on], rows[on], at[on], best[on]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[:, :-1] = np.where(np.arange(ids.shape[1] - 1)[None, :] > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(np.arange(ranks.shape[1] - 1)[None, :] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_PAIR
            ids[here, at] = best
            left = np.maximum(at - 1, 0)
            fresh = self.pair_ranks(np.concatenate([ids[here, at], ids[here, left]]), np.concatenate([ids[here, at + 1], best]))
            ranks[here, at] = fresh[: len(rows)]
            some = at > 0
            ranks[here[some], left[some]] = fresh[len(rows) :][some]
            used = int((ids >= 0).sum(1).max())
            if used + 1 < ids.shape[1]:
                ids, ranks = np.ascontiguousarray(ids[:, : used + 1]), np.ascontiguousarray(ranks[:, :used])
        kept = done >= 0
        return done[kept], kept.sum(1)


class PieceTable:
    """Numbers by short pieces, in arrays with open addressing, looked up for all pieces of a batch at once.

    A piece of at most SHORT_PIECE bytes and its length fill 16 bytes, so keys
    are compared in full and no piece is taken for another.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.count, self.bits = 0, 16
        self.rows = np.zeros((1 << self.bits, 3), np.uint64)  # bytes 0 to 7; bytes 8 to 14 and the length, 0 where free; the number

    def keys(self, data: bytes, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows (first key, second key) of the pieces of ``data`` that start at ``places``."""
        padded = data + bytes(16)
        words = np.ndarray(len(data) + 1, "V16", padded, strides=(1,))[places].view("<u8").reshape(-1, 2)
        words &= _KEPT_BYTES[sizes]
        words[:, 1] |= sizes.astype(np.uint64) << np.uint64(56)
        return words

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at = self._slots(keys)
        there = np.take(self.rows, at, axis=0)
        same = (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1])
        out = np.where(same, there[:, 2].view(np.int64), -1)
        open_ = np.flatnonzero(~same & (there[:, 1] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there, wanted = self.rows[at[open_]], keys[open_]
            same = (there[:, 0] == wanted[:, 0]) & (there[:, 1] == wanted[:, 1])
            out[open_[same]] = there[same, 2]
            open_ = open_[~same & (there[:, 1] != 0)]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct keys that aren't there."""
        if 2 * (self.count + len(keys)) > len(self.rows):
            held = self.rows[self.rows[:, 1] != 0]
            self.bits = max(self.bits + 1, (4 * (self.count + len(keys))).bit_length())
            self.rows, self.count = np.zeros((1 << self.bits, 3), np.uint64), 0
            self.put(held[:, :2], held[:, 2])
        self.count += len(keys)
        rows = np.column_stack([keys, numbers.astype(np.uint64)])
        at = self._slots(keys)
        while len(at):
            free = np.flatnonzero(self.rows[at, 1] == 0)
            slots, first = np.unique(at[free], return_index=True)  # of those that want the same slot, one
            self.rows[slots] = rows[free[first]]
            rest = np.ones(len(at), bool)
            rest[free[first]] = False
            rows, at = rows[rest], (at[rest] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Texts to ids.  Merged pieces stay in a cache of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.table = PieceTable()  # piece -> offset of its ids << 32 | how many
        self.pieces: dict[bytes, int] = {}  # the same for longer pieces
        self.ids = array("i")

    def _merge(self, missing: list[bytes]) -> None:
        for lo, hi in ((0, 8), (8, SHORT_PIECE), (SHORT_PIECE, LONG_PIECE)):
            part = [p for p in missing if lo < len(p) <= hi]
            for k in range(0, len(part), 1 << 15):
                some = part[k : k + (1 << 15)]
                ids, counts = self.vocabulary.merge_many(some)
                packed = (len(self.ids) + np.cumsum(counts) - counts) << 32 | counts
                self.ids.frombytes(ids.astype(np.int32).tobytes())
                if hi <= SHORT_PIECE:
                    sizes = np.fromiter(map(len, some), np.int64, len(some))
                    self.table.put(self.table.keys(b"".join(some), np.cumsum(sizes) - sizes, sizes), packed)
                else:
                    self.pieces.update(zip(some, packed.tolist(), strict=True))
        for p in missing:
            if len(p) > LONG_PIECE:
                out = self.vocabulary.merge_long(p)
                self.pieces[p] = (len(self.ids) << 32) | len(out)
                self.ids.extend(out)

    def _packed(self, data: bytes, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of each piece of ``data`` are; those that aren't known are merged."""
        short, long = np.flatnonzero(sizes <= SHORT_PIECE), np.flatnonzero(sizes > SHORT_PIECE)
        every = len(long) == 0
        keys = self.table.keys(data, places if every else places[short], sizes if every else sizes[short])
        found = self.table.find(keys)
        begins = places[long].tolist()
        others = [data[a : a + n] for a, n in zip(begins, sizes[long].tolist(), strict=True)]
        new = np.flatnonzero(found < 0)
        unknown = short[new]
        missing = [data[a : a + n] for a, n in zip(places[unknown].tolist(), sizes[unknown].tolist(), strict=True)]
        missing += [p for p in others if p not in self.pieces]
        if missing:
            self._merge(list(dict.fromkeys(missing)))
            found[new] = self.table.find(keys[new])
        if every:
            return found
        out = np.empty(len(sizes), np.int64)
        out[short] = found
        out[long] = np.fromiter(map(self.pieces.__getitem__, others), np.int64, len(others))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text, piece ends as code points within all texts, pieces per text)."""
        joined = "".join(texts)
        if not joined:
            zero = np.zeros(len(texts), np.int64)
            return np.zeros(0, np.int32), zero, np.zeros(0, np.int64), zero
        data, points = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(token_starts(points, begins[sizes > 0]))
        places = starts
        if len(data) > len(points):  # from code points to bytes
            places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        if self.table.count + len(self.pieces) > CACHED_PIECES or len(self.ids) > CACHED_IDS:
            self.table.clear()
            self.pieces.clear()
            self.ids = array("i")
        packed = self._packed(data, places, np.diff(places, append=len(data)))
        counts, offsets = packed & 0xFFFFFFFF, packed >> 32
        ends = np.cumsum(counts)
        total = int(ends[-1])
        take = np.repeat(offsets - (ends - counts), counts) + np.arange(total)
        ids = np.frombuffer(self.ids, np.int32)[take]
        first = np.searchsorted(starts, begins)  # of each text's pieces
        per_text = np.diff(np.append(first, len(starts)))
        before = np.concatenate([[0], ends])
        return ids, before[first + per_text] - before[first], np.append(starts[1:], len(joined)), per_text

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        lengths = v.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        take = np.repeat(v.offsets[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        return v.blob[take].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a ranks file, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


def _binary(parts: list[memoryview | bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _cut(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary array of consecutive pieces of ``data``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def encode(docs: DataFrame, ranks_path: str, *, offsets: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids[, piece_ends]) of documents (doc_id, text).

    ``ids`` holds unsigned 32-bit little-endian token ids of the whole text.
    ``piece_ends``, if asked for: where each pre-token ends, in code points of
    the text, as unsigned 32-bit little-endian numbers.  One row for each input
    row, repeated and null ids included; a null text counts as empty and has no
    tokens; texts may be of any length; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        fields.append(T.StructField("piece_ends", T.BinaryType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        for batch, texts in slices(batches, "text"):
            ids, counts, ends, pieces = coder.encode(texts)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), _cut(ids.astype("<u4").tobytes(), counts * 4)]
            if offsets:
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                own = ends - np.repeat(np.cumsum(sizes) - sizes, pieces)
                columns.append(_cut(own.astype("<u4").tobytes(), pieces * 4))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Replaces the column ``ids`` by ``decoded``, the bytes that the ids stand for; keeps the others (null ids: no bytes)."""
    fields = [f for f in encoded.schema.fields if f.name != "ids"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        for whole in batches:
            start, parts, sizes = 0, [], []
            for i, x in enumerate(whole.column("ids")):
                parts.append(np.frombuffer(x.as_py() or b"", "<u4"))
                sizes.append(int(coder.vocabulary.lengths[parts[-1]].sum()))
                if i + 1 == whole.num_rows or len(parts) == 64 or sum(sizes) > DECODED_BYTES:
                    batch, out = whole.slice(start, len(parts)), coder.decode(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _cut(out, np.array(sizes, np.int64))], names=[*names, "decoded"])
                    start, parts, sizes = i + 1, [], []

    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))
