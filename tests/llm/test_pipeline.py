"""The corpus pipeline: each stage against its operator's rule."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from loamworks.llm import queries
from loamworks.llm.common import stored

from .conftest import by_row, sentence


def test_stages(spark, small):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    assert len(cp.STAGES) == 5
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, small), f"test-{name}")
        now = [r["doc_id"] for r in docs.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids[-1]
        ids.append(set(now))
        if name == "quality":
            rejected = {r["doc_id"] for r in queries.op9_quality(spark, small).collect() if not r["predicted"]}
            assert ids[-1] == ids[0] - rejected and rejected
        if name == "substring_dedup":
            assert ids[-1] == ids[-2]
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            changed = [r for r in docs.collect() if r["text"] != text[r["doc_id"]]]
            assert all(r["n_chars"] == len(r["text"]) for r in changed)
        if name != "tokens":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    whole = e.queries()["pipeline"](spark, small)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in whole.collect()) == sorted((r["doc_id"], bytes(r["ids"])) for r in docs.collect())


def test_stages_on_odd_tables(spark, edge_docs, no_docs, small):
    for docs in (edge_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, small)
            assert out.columns == (docs.columns if name != "tokens" else ["doc_id", "n_tokens", "ids"])
            assert out.count() <= docs.count()


def test_one_of_each_group(spark, small):
    base = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(3, base), (1, base.upper()), (1, base), (2, "something else that is entirely different from it"), (None, base)], "doc_id long, text string")
    kept = cp.near_dedup(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_one_row_of_each_group(spark, small):
    """By id, rows without id last, then by the text's hash; groups don't share a choice."""
    rng = random.Random(8)
    a, b, c, d, e, f = (sentence(rng, 60) for _ in range(6))
    rows = [(1, a), (1, b), (2, b.upper()), (2, b), (0, c), (1, c.upper()), (None, d), (None, d), (None, d.upper()), (None, e), (None, a), (4, f), (4, f), (4, f.upper())]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, digest string, kept_id string")
    kept = cp.near_dedup(spark, docs, small)
    assert kept.columns == docs.columns
    got = by_row(kept.selectExpr("doc_id", "lower(text) AS text"), "doc_id", "text")
    assert got == sorted([(1, a), (1, b), (0, c), (None, d), (None, e), (4, f)], key=lambda t: [(v is not None, v) for v in t])
    assert by_row(kept, "doc_id", "text") == by_row(cp.near_dedup(spark, docs.repartition(5), small), "doc_id", "text")
