"""SimHash components, repeated passages and contained items against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from loamworks.llm import decontaminate, queries, simhash, substring
from loamworks.llm.components import connected_components
from pyspark.sql import functions as F

from ..conftest import same_rows
from .conftest import by_row, edge_texts, sentence

M64 = 2**64 - 1


def print_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def components(prints, most=4):
    """The least position of each one's component."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= most).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op4(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [print_of(t) for _, t in docs]
    want = [(k, f"{p:016x}", docs[c][0]) for (k, _), p, c in zip(docs, prints, components(prints), strict=True)]
    assert by_row(queries.op4_simhash(spark, small), "doc_id", "fingerprint", "component_id") == want


def test_simhash_edge(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    texts = [*edge_texts(), edge_texts()[5]]
    assert sorted(r["fingerprint"] for r in rows) == sorted(f"{print_of(t):016x}" for t in texts)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}  # null, empty and blank texts
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 8)} == {5}  # case only; one row comes twice
    assert simhash.near_duplicates(no_docs).count() == 0


def test_anchors_meet(spark):
    """Random clusters, chains and a dense one: components equal those of all pairs."""
    rng = random.Random(1)
    points = []
    for _ in range(120):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << b
            points.append(y)
            x = y if rng.random() < 0.5 else x
    centre = rng.getrandbits(64)
    for _ in range(250):
        y = centre
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            y ^= 1 << b
        points.append(y)
    points = sorted(set(points), key=lambda p: np.uint64(p).view(np.int64))
    signed = np.array(points, np.uint64).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"fingerprint": signed}))
    for most in (simhash.GROUP, 40, 7):
        placed = simhash.place(df, most)
        assert most < 100 or placed.count() < 50 * len(points)
        assert placed.groupBy("unit").count().agg(F.max("count")).first()[0] <= max(4 * most, 40)
        links = placed.repartition(3, "unit").sortWithinPartitions("unit").mapInArrow(simhash._link, simhash.LINKS)
        root = {r["node"]: r["root"] for r in connected_components(links).collect()}
        assert [root.get(p, p) for p in signed.tolist()] == [int(signed[c]) for c in components(points)]


def test_an_anchor_of_many_prints(spark):
    """All share a segment, so they meet at its anchors all at once; planted ones are found there."""
    rng = np.random.default_rng(6)
    prints = np.unique(rng.integers(0, 1 << 43, 101_000, dtype=np.uint64)) << np.uint64(21)
    near = [(int(x), int(x) ^ sum(1 << int(b) for b in rng.choice(np.arange(21, 64), 4, replace=False))) for x in prints[::1000]]
    every = np.unique(np.concatenate([prints, np.array([y for _, y in near], np.uint64)])).view(np.int64)
    placed = simhash.place(spark.createDataFrame(pd.DataFrame({"fingerprint": every})))
    largest = placed.groupBy("unit").count().agg(F.max("count")).first()[0]
    assert len(every) > 10**5 and largest <= 2.2 * simhash.GROUP
    one = placed.where("unit % pow(2, 24) = 0")  # the anchor that is the segment itself
    links = one.repartition(8, "unit").sortWithinPartitions("unit").mapInArrow(simhash._link, simhash.LINKS)
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    signed = [tuple(np.array(p, np.uint64).view(np.int64).tolist()) for p in near]
    assert all(x in root and root[x] == root[y] for x, y in signed) and len(root) < 1000


def test_covering_radius():
    reached = {e for row in simhash.flips(15) for e in row}
    assert len(reached) == 1 + 15 + 105
    for word in random.Random(2).sample(range(2**15), 200):  # an anchor within 1, and all within 2
        near = [e for e in simhash.flips(15)[simhash._syndrome(word)]]
        assert min(bin(e).count("1") for e in near) <= 1
        assert {word ^ e for e in near} == {w for w in (word ^ e for e in reached) if simhash._syndrome(w) == 0}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (300, 299)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 299: 299, 300: 299, **{k: 500 for k in range(500, 560)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = b"\1" * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "\x01x", "é"] + [f"w{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(30, 110))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                p, a = rng.choice(shared), rng.randrange(0, 15)
                w += p[a : a + rng.randrange(10, 100)]
            elif kind < 0.5:
                w += ["again"] * rng.randrange(20, 100)
            else:
                w += [rng.choice(words) for _ in range(rng.randrange(1, 50))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return [*texts, texts[0], texts[1]]


@pytest.mark.parametrize("group_rows", [substring.GROUP_ROWS, 6])
def test_substring_against_brute_force(spark, group_rows):
    texts = passages(group_rows, 160)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, group_rows=group_rows).collect()}
    for i, (n, removed, sha, kept) in enumerate(cut(texts)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, sha)
        assert r["text"] == (kept if removed else texts[i])


def test_substring_edge(spark, edge_docs, no_docs):
    out = substring.remove_repeats(edge_docs)
    assert set(out.columns) == {*edge_docs.columns, "n_removed", "kept_sha256"}
    rows = out.collect()
    texts = [*edge_texts(), edge_texts()[5]]
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == sorted(c[:3] for c in cut(texts))
    assert {r["_uid"] for r in rows} == {"z"} and sum(r["text"] is None for r in rows) == texts.count(None)
    assert substring.remove_repeats(no_docs).count() == 0


def test_op5(spark, small, tables):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = [(k, *c[:3]) for (k, _), c in zip(docs, cut([t for _, t in docs]), strict=True)]
    assert by_row(queries.op5_substring(spark, small), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    same_rows(queries.op5_substring(spark, small), tables.sql(queries.SQL["op5_substring"]))


def test_sql_of_op5_on_odd_texts():
    import duckdb

    texts = [*edge_texts(), *passages(4, 60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i if i % 7 else None, t) for i, t in enumerate(texts)])
    assert sorted(r[1:] for r in con.sql(queries.SQL["op5_substring"]).fetchall()) == sorted(c[:3] for c in cut(texts))


def test_tree_nodes():
    depths = [2, 5, 5, 1, 3]
    assert sorted(substring.nodes(depths)) == [(0, 3, 2), (0, 5, 1), (1, 3, 5), (4, 5, 3)]


def contained(docs, items):
    def shingles(t):
        w = [x for x in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        return w, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = set()
    for d, t in docs:
        words, own = shingles(t)
        for i, x in items:
            item, want = shingles(x)
            if 0 < (n := len(item)) < 5:
                if any(words[k : k + n] == item for k in range(len(words) - n + 1)):
                    out.add((d, i, 1, 1))
            elif want and len(want & own) / len(want) >= 0.8:
                out.add((d, i, len(want), len(want & own)))
    return out


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_decontaminate_against_brute_force(spark, limit, monkeypatch):
    """The sketch within the limit of broadcasts, and beyond it."""
    monkeypatch.setattr(decontaminate, "FILTER_ABOVE", 1 if limit == "-1" else decontaminate.FILTER_ABOVE)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        _decontaminate_against_brute_force(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _decontaminate_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate([5, 6, 9, 13, 14, 20, 33, 64, 65, 120])] + [(20, "two words"), (23, "what is entropy"), (24, "Zq"), (21, None), (22, ""), (None, sentence(rng, 12))]
    docs = []
    for d in range(120):
        words = sentence(rng, rng.randrange(0, 300)).split()
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1] or ""
            part = part.upper().split()
            for k in range(rng.randrange(0, 3)):  # some changed words
                if part:
                    part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(900, "Two\nWORDS"), (901, None), (902, ""), (903, items[3][1] * 2), (904, "so I asked What  is\nENTROPY and why"), (905, "what is an entropy"), (906, "a zq b"), (907, "what is entropy"), (None, items[5][1])]
    ds, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(ds, its).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got} == contained(docs, items) and len(got) == len(contained(docs, items))
    leaks = {d for d, *_ in contained(docs, items)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(ds, its).collect()) == sorted(d for d, _ in docs if d not in leaks)
    assert decontaminate.contained_items(ds.limit(0), its).count() == 0 and decontaminate.contained_items(ds, its.limit(0)).count() == 0


def test_decontaminate_rows_that_share_an_id(spark):
    rng = random.Random(6)
    item, clean = sentence(rng, 20), [sentence(rng, 40) for _ in range(4)]
    docs = [(None, clean[0]), (None, f"{clean[1]} {item}"), (None, None), (1, clean[2]), (1, f"{item} {clean[2]}"), (2, clean[3]), (2, clean[3]), (3, item), (3, item)]
    ds, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.decontaminate(ds, its)
    assert by_row(got, "doc_id", "text") == sorted([(None, clean[0]), (None, None), (1, clean[2]), (2, clean[3]), (2, clean[3])], key=lambda t: [(v is not None, v) for v in t])
    assert by_row(decontaminate.contained_items(ds, its), "doc_id", "item_id", "containment") == [(None, 7, 1.0), (1, 7, 1.0), (3, 7, 1.0)]


def test_decontaminate_edge(spark, edge_docs):
    items = spark.createDataFrame([(1, "it's we'll don't 'x' 1234", "z")], "item_id long, text string, hash string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(edge_docs, items).collect()] == [(13, 1)]
    same = spark.createDataFrame([(1, edge_texts()[5], "z"), (1, edge_texts()[5], "z")], "item_id long, text string, hash string")
    assert by_row(decontaminate.contained_items(edge_docs, same), "doc_id", "containment") == [(None, 1.0), (5, 1.0), (7, 1.0), (8, 1.0)]
    assert set(decontaminate.decontaminate(edge_docs, same).columns) == set(edge_docs.columns)


def test_op6(spark, small, tables):
    same_rows(queries.op6_decontaminate(spark, small), tables.sql(queries.SQL["op6_decontaminate"]))
