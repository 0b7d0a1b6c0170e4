"""Byte-level BPE, token counts and sequence files against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as s
from loamworks.llm import arrow_output, bpe, queries, token_counts, tokenizer_file
from loamworks.llm.common import shared_dir
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import by_row, edge_texts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.Vocabulary.load(RANKS))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


SOUP = s.text(s.one_of(s.sampled_from("'strevlmdaZ 19.!\n\t 　\u0085é́²漢😀"), s.characters(exclude_categories=["Cs", "Cn"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(s.lists(SOUP, min_size=1, max_size=6))
def test_slices_are_the_patterns_matches(coder, texts):
    _, _, ends, pieces = coder.encode(texts)
    at = base = 0
    for t, n in zip(texts, pieces.tolist(), strict=True):
        own = (ends[at : at + n] - base).tolist()
        assert own == [m.end() for m in regex.finditer(P.PATTERN, t)]
        at, base = at + n, base + len(t)


@settings(max_examples=150, deadline=None)
@given(s.lists(SOUP, min_size=1, max_size=6))
def test_ids_equal_the_libraries(coder, tik, texts):
    ids, counts = coder.encode(texts)[:2]
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [tik.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == "".join(texts).encode()


def test_table_is_a_dictionary():
    """Pieces that differ in a last zero byte, that are as long as a key can hold, and that make the table grow."""
    rng = random.Random(5)
    pieces = list(dict.fromkeys([b"a", b"a\0", b"\0", b"\0\0", b"b" * bpe.SHORT_PIECE, b"b" * (bpe.SHORT_PIECE - 1), *(rng.randbytes(rng.randint(1, bpe.SHORT_PIECE)) for _ in range(150_000))]))
    table, known = bpe.PieceTable(), {}

    def keys(some):
        sizes = np.array(list(map(len, some)), np.int64)
        return table.keys(b"".join(some), np.cumsum(sizes) - sizes, sizes)

    assert table.find(keys(pieces[:9])).tolist() == [-1] * 9 and len(table.find(keys([]))) == 0
    for part in (pieces[:3], pieces[3:50_000], pieces[50_000:]):
        numbers = np.arange(len(known), len(known) + len(part))
        table.put(keys(part), numbers)
        known |= dict(zip(part, numbers.tolist(), strict=True))
        assert table.find(keys(pieces)).tolist() == [known.get(p, -1) for p in pieces]
    table.clear()
    assert (table.find(keys(pieces)) == -1).all()


def test_cached_pieces_of_all_lengths(tik, monkeypatch):
    """Long pieces alone, both kinds mixed, known or not, and a cache that is emptied all the time."""
    texts = ["x" * 40, "x" * 15 + " " + "y" * 15 + "é" * 8, "a\0 a\0\0 a", "one two " + "z" * 16, "漢字" * 30 + " ok", ""]
    for most in (bpe.CACHED_PIECES, 1):
        monkeypatch.setattr(bpe, "CACHED_PIECES", most)
        own = bpe.Encoder(bpe.Vocabulary.load(RANKS))
        for some in [*([t] for t in texts), texts, texts[::-1]]:
            ids, counts = own.encode(some)[:2]
            assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [tik.encode_ordinary(t) for t in some]


def test_scan_is_the_automaton():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, bpe.CLASSES, 20_000)
    functions = kinds.astype(np.int32)
    functions[::997] += bpe.CLASSES
    state, want = bpe.START, []
    for i, k in enumerate(kinds.tolist()):
        state = bpe.step(bpe.START if i % 997 == 0 else state, k)
        want.append(state)
    assert bpe.scan(functions).tolist() == want


def test_long_and_rare_pieces(coder, tik):
    rng = random.Random(3)
    for t in ["a" * 3000, "'" * 900, " " * 700 + "x", "".join(rng.choice("abcdeé") for _ in range(2000)), "the" * 500]:
        assert coder.encode([t])[0].tolist() == tik.encode_ordinary(t)


def test_encode_decode_edge(spark, edge_docs, no_docs, tik):
    coded = bpe.encode(edge_docs, RANKS, offsets=True)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "piece_ends"] and coded.count() == len(edge_texts()) + 1
    want = sorted(np.array(tik.encode_ordinary(t or ""), "<u4").tobytes() for t in [*edge_texts(), edge_texts()[5]])
    assert sorted(bytes(r["ids"]) for r in coded.collect()) == want
    back = bpe.decode(coded, RANKS)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for t in [*edge_texts(), edge_texts()[5]])
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0


def test_op7(spark, small, tik):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op7_byte_bpe(spark, small).collect():
        text = docs.pop(r["doc_id"])
        ids = tik.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not docs


@settings(max_examples=150, deadline=None)
@given(s.lists(s.one_of(SOUP, SOUP.map(lambda t: f"{t}<|endoftext|>{t}<|endoftext|>")), min_size=1, max_size=6))
def test_tokenizer_file_equals_the_library(library, texts):
    ids, counts = tokenizer_file.load(JSON).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizers_go_to_their_libraries():
    import sentencepiece

    texts = ["Hello there, it's 12 o'clock.", "", "日本 😀"]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        found = tokenizer_file.load(P.path(name))
        assert isinstance(found, tokenizer_file.LibraryEncoder)
        counts = found.encode(texts)[1].tolist()
        if name.endswith(".model"):
            assert counts == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
        else:
            assert counts == [len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids) for t in texts]
    spec = json.load(open(JSON))
    spec["model"]["byte_fallback"] = True
    assert not tokenizer_file.is_plain_byte_level(spec)


def test_only_listed_merges_merge():
    """A file whose tokens could also be reached by pairs that it doesn't list."""
    spec = json.load(open(JSON))
    letters = {c: spec["model"]["vocab"][c] for c in map(chr, [*range(33, 127), *range(161, 173), *range(174, 256), *range(256, 324)]) if c in spec["model"]["vocab"]}
    n = max(letters.values())
    spec["model"]["vocab"] = letters | {"bc": n + 1, "ab": n + 2, "abc": n + 3, "abcd": n + 4}
    spec["model"]["merges"] = [["b", "c"], ["a", "b"], ["ab", "c"], ["abc", "d"]]
    spec["added_tokens"] = []
    assert tokenizer_file.is_plain_byte_level(spec)
    own, library = tokenizer_file.PieceEncoder(spec), Tokenizer.from_str(json.dumps(spec))
    for text in ("abc", "abcd", "abab", "bcab", "abc" * 30, "abcdabcbab" * 9):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_content_with_two_counts(spark):
    docs, cache = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), shared_dir(spark, "cache")
    token_counts.count_tokens(docs, JSON, cache).count()
    token_counts.read_cache(spark, cache).withColumn("n_tokens", F.col("n_tokens") + 1).write.mode("append").parquet(cache)
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs, JSON, cache).collect()] == [2]


def test_counts_edge_and_cache(spark, edge_docs, no_docs, library):
    cache = shared_dir(spark, "cache")
    texts = [*edge_texts(), edge_texts()[5]]
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    for _ in range(2):  # the second time all are known
        got = token_counts.count_tokens(edge_docs, JSON, cache)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(no_docs, JSON, shared_dir(spark, "cache")).count() == 0
    changed = token_counts.read_cache(spark, cache).withColumn("n_tokens", F.lit(5).cast("long"))
    other = shared_dir(spark, "cache")
    changed.write.parquet(other)  # stored counts are used, not made again
    assert {r["n_tokens"] for r in token_counts.count_tokens(edge_docs, JSON, other).collect()} == {5}


def test_op8(spark, small, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op8_token_counts(spark, small).collect()}
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in docs.items()}
    assert got == {k: (len(docs[k].encode()), n, n > 1024) for k, n in want.items()}


@pytest.mark.parametrize("file_ids", [arrow_output.FILE_IDS, 100])
def test_sequences_edge(spark, edge_docs, no_docs, library, file_ids):
    folder = shared_dir(spark, "sequences")
    files = arrow_output.write_sequences(edge_docs, folder, JSON, length=64, file_ids=file_ids)
    assert files.groupBy("shard").count().where("count > 1").count() > 0 or file_ids > 100
    got = arrow_output.read_sequences(spark, folder, files, edge_docs.schema["doc_id"].dataType).collect()
    texts = [*edge_texts(), edge_texts()[5]]
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts)
    assert sorted(bytes(r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # end to end, ids ascending, null ids first
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    empty = shared_dir(spark, "sequences")
    none = arrow_output.write_sequences(no_docs, empty, JSON)
    assert arrow_output.read_sequences(spark, empty, none, no_docs.schema["doc_id"].dataType).count() == 0


def test_stream_file_random_access():
    import pyarrow as pa

    ids = np.arange(5000, dtype=np.uint16)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3000, 2000])], names=["doc_id", "n_tokens"])
    def stream(*given):
        arrow_output.write_stream(sink := pa.BufferOutputStream(), *given)
        return sink.getvalue()

    data = stream(ids, 8, docs, 3, 40)
    file = arrow_output.StreamFile(data)
    assert len(file) == 625 and file.ids().tolist() == ids.tolist()
    got, mask = file.sequence(600)
    assert got.tolist() == ids[4800:4808].tolist() and mask.true_count == 8
    assert data.address <= got.__array_interface__["data"][0] < data.address + data.size  # a view of the file
    odd = arrow_output.StreamFile(stream(ids[:10], 8, docs, 0, 0))
    assert odd.sequence(1)[1].to_pylist() == [True] * 2 + [False] * 6


def test_op10(spark, small, library):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want, at = [], 0
    for k, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_row(queries.op10_arrow_sequences(spark, small), "doc_id", "start", "n_tokens", "ids_crc32") == want
