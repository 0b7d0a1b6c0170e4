"""Language identification and quality: exact parts against brute force, the rest by held-out accuracy."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers as P
import regex
from loamworks.llm import langid, quality, queries

from pyspark.sql import functions as F

from .conftest import by_row, edge_texts

PIECES = P.path("piece_bpe_32k.model")


def segmentations(word, vocabulary, p):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        i = vocabulary.ids.get(word[:k], langid.UNKNOWN if k == 1 else -1)
        if i >= 0:
            total += p[i + 1] * segmentations(word[k:], vocabulary, p)
    return total


def test_forward_sums_all_segmentations():
    names, p = langid.fit([("x", "the", 5), ("x", "there", 2), ("y", "straße", 3), ("y", "der", 9)], PIECES)
    scorer = langid.Scorer(PIECES, p)
    for word in ["the", "there", "ñandu", "straße", "日本x", "a"]:
        want = [np.log(segmentations(langid.MARK + word, scorer.vocabulary, p[r])) for r in range(2)]
        assert np.allclose(scorer.score([word])[0][0], want) and np.allclose(scorer._long(word), want)
    both = scorer.score(["the  Straße!", "", "x" * 500])
    assert np.allclose(both[0][0], scorer.score(["the"])[0][0] + scorer.score(["straße"])[0][0]) and both[1].tolist() == [2, 0, 1]
    assert np.isfinite(both[0]).all()


def test_long_words_are_learned_from_as_short_ones_are(monkeypatch):
    counts = [("x", "the", 5), ("x", "thereafter", 2), ("y", "straßenbahn", 3), ("y", "日本x", 9), ("y", "a", 1)]
    want = langid.fit(counts, PIECES)[1]
    monkeypatch.setattr(langid, "LONG_WORD", 0)
    assert np.allclose(langid.fit(counts, PIECES)[1], want, rtol=1e-9, atol=0)
    whole = langid.fit([("x", "thereafter" * 60, 1)], PIECES)[1]
    monkeypatch.setattr(langid, "LONG_SLICE", 7)
    assert np.allclose(langid.fit(counts, PIECES)[1], want, rtol=1e-9, atol=0)
    assert np.allclose(langid.fit([("x", "thereafter" * 60, 1)], PIECES)[1], whole, rtol=1e-9, atol=0) and np.isfinite(whole).all()


def test_a_language_of_long_words_alone(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:12]
    english, unspaced = "the other words are here and there", "日本語の文章は空白なしで続く" * 5
    rows = [(i, english, "en") for i in ids[:6]] + [(i, unspaced, "ja") for i in ids[6:11]] + [(ids[11], "q" * 5000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, PIECES).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in rows)
    assert np.isfinite(langid.fit([("aa", "", 0), ("en", "the", 2)], PIECES)[1]).all()


def test_fit_raises_the_likelihood():
    counts = [("x", w, c) for w, c in (("the", 9), ("then", 4), ("other", 3), ("hat", 2))]

    def likelihood(rounds):
        scorer = langid.Scorer(PIECES, langid.fit(counts, PIECES, rounds)[1])
        return sum(c * scorer.score([w])[0][0, 0] for _, w, c in counts)

    assert likelihood(1) < likelihood(2) < likelihood(4)


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_langid(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_langid_edge(spark, edge_docs, no_docs):
    got = langid.identify(edge_docs, PIECES, texts_per_language=20).collect()
    assert len(got) == len(edge_texts()) + 1
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == sum(not regex.search(r"\p{L}", t or "") for t in edge_texts())
    unknown = edge_docs.withColumn("lang", edge_docs["source"])
    assert {r["lang_pred"] for r in langid.identify(unknown, PIECES).collect()} == {"und"}
    assert langid.identify(no_docs, PIECES).count() == 0


def test_only_letters_are_letters(spark):
    signs = "½ ²³ ① Ⅷ 12 _ x² é́a ªb"
    assert langid.words(signs) == regex.findall(r"\p{L}+", signs.lower()) == ["x", "é", "a", "ªb"]
    rows = [(1, "½ ²³ ①", None), (2, "Ⅷ 12 _", None), (3, "the x²", None)] + [(i, "the other words", "en") for i in range(4, 20)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3] == ("en", 1.0)


def splits(word, vocabulary):
    """All segmentations, as lists of pieces' ids."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        i = vocabulary.ids.get(word[:k], langid.UNKNOWN if k == 1 else -1)
        if i >= 0:
            for rest in splits(word[k:], vocabulary):
                yield [i, *rest]


def test_identify_against_brute_force(spark):
    texts = {"en": ["the cat is there", "then the hat"], "de": ["der hut ist da", "die katze"], "fr": ["le chat est là", "un chapeau ½"]}
    rows, own = [], [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    for lang, some in texts.items():
        rows += [(own.pop(), t, lang) for t in some * 2]
    rows += [(i, t, "xx") for i, t in zip([i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0], ["the hut", "chat là", "katze Ⅷ the", "① 3"])]
    vocabulary, names = langid.pieces(PIECES), sorted(texts)
    counts = {n: collections.Counter(w for _, t, lang in rows if lang == n for w in regex.findall(r"\p{L}+", t.lower())) for n in names}
    p = {n: np.full(vocabulary.size, 1 / vocabulary.size) for n in names}
    for _ in range(langid.ROUNDS):
        for n in names:
            total = np.zeros(vocabulary.size)
            for w, c in counts[n].items():
                every = list(splits(langid.MARK + w, vocabulary))
                weights = np.array([np.prod(p[n][s]) for s in every])
                for s, x in zip(every, weights / weights.sum()):
                    np.add.at(total, s, c * x)
            total += langid.FLOOR * total.sum()
            p[n] = total / total.sum()
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    for i, t, _ in rows:
        found = regex.findall(r"\p{L}+", t.lower())
        logs = np.array([sum(np.log(sum(np.prod(p[n][s]) for s in splits(langid.MARK + w, vocabulary))) for w in found) for n in names])
        share = np.exp(logs - logs.max())
        want = (names[int(logs.argmax())], 1 / share.sum()) if found else ("und", 0.0)
        assert got[i]["lang_pred"] == want[0] and np.isclose(got[i]["score"], want[1])


def test_vote_is_exact():
    rng = np.random.default_rng(0)
    near, some, labels = rng.standard_normal((80, 6)), rng.standard_normal((50, 6)), rng.integers(0, 2, 80).astype(float)
    near, some = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (near, some))
    some[3] = 0
    got = quality.vote(some, near, labels)
    for v, s in zip(some, got, strict=True):
        cos = near @ v
        top = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[top], 0) ** quality.SHARPNESS
        assert np.isclose(s, (w * labels[top]).sum() / w.sum() if w.sum() else quality.UNSURE)


def test_term_counts_by_hand():
    counts = quality.term_counts(["ab ab", "", "é", "ab"])
    kinds = quality.byte_classes()
    pair = kinds[ord("a")] * quality.CLASSES + kinds[ord("b")]
    assert counts[:, pair].tolist() == [2, 0, 0, 1] and counts[:, : quality.PAIRS].sum(1).tolist() == [4, 0, 1, 1]
    assert counts[:, quality.PAIRS].tolist() == [1, 0, 0, 0]


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op9_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93


def slow_counts(text):
    """Terms of one text, one at a time."""
    raw, out = text.encode(), np.zeros(quality.TERMS)
    kinds = quality.byte_classes()
    for a, b in zip(raw, raw[1:]):
        out[kinds[a] * quality.CLASSES + kinds[b]] += 1
    words = raw.split()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    out[quality.PAIRS] = repeats
    share = min(100 * repeats // len(words), 99) if words else 0
    if share:
        out[quality.PAIRS + 1 + min(int(np.ceil(np.log2(share + 1))), 7)] = len(words)
    return out


def test_score_against_brute_force(spark):
    """The space of few texts is that of all of them, so projections and votes can be made one by one."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh XY,.1")) if i % 2 else rng.choice(list("mnopqrst ,."))  for _ in range(60)) + " la la" * (i % 3) for i in range(70)] + ["", "a"]
    labelled = [i for i in range(70) if zlib.crc32(str(i).encode()) % 5][:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in labelled] + [(i, 1) for i in range(70) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    counts = np.stack([slow_counts(texts[i]) for i in labelled])
    weights = np.where(counts.any(0), np.log((1 + len(labelled)) / (1 + (counts > 0).sum(0))) + 0.2, 0)

    def unit(x):
        return x / n if (n := np.linalg.norm(x)) > 1e-9 else x * 0

    space = np.stack([unit(np.log1p(c) * weights) for c in counts])
    project = np.linalg.pinv(space) @ space
    near = np.stack([unit(project @ x) for x in space])
    for i, t in enumerate(texts):
        z = unit(project @ unit(np.log1p(slow_counts(t)) * weights))
        cosines = near @ z
        top = np.argsort(-cosines)[: quality.NEIGHBOURS]
        w = np.maximum(cosines[top], 0) ** quality.SHARPNESS
        want = (w * np.array([labelled[j] % 2 for j in top])).sum() / w.sum() if w.sum() > 0 else quality.UNSURE
        assert np.isclose(got[i], want, atol=1e-6), (i, t)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.select("doc_id", "text").union(docs.selectExpr("doc_id", "reverse(text)").where("doc_id % 3 = 0"))
    first = quality.score(some, labels, keep=("doc_id", "text"))
    again = quality.score(some.orderBy(F.desc("text")).repartition(3), labels.orderBy(F.rand(4)), keep=("doc_id", "text"))
    assert by_row(first, "doc_id", "text", "score") == by_row(again, "doc_id", "text", "score")


def test_quality_edge(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None, "z") for i in range(1, 18)] + [(None, 1, None, None), (4, None, 1, "z"), (7, 5, 1, "z")], "doc_id long, quality int, toxic int, score string")
    got = quality.score(edge_docs, labels).collect()
    assert len(got) == len(edge_texts()) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(edge_docs, labels.limit(0)).collect()} == {quality.UNSURE}
    assert quality.score(no_docs, labels).count() == 0
