"""Text functions against plain models over 16-bit units."""

from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s
from loamworks.functions import text as tx
from loamworks.operators import chunking as ch
from pyspark.sql import functions as F

ALPHABET = [*"abE.!? \n\r\t1-", "\u00a0", "\ufeff", "\u00e9", "\u0301", "\U0001f600", "\u00df", "\u6f22", "\u2003"]
WS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def units(t):
    return len(t.encode("utf-16-le")) // 2


def fnv(t):
    h, raw = 0x811C9DC5, t.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return h


def normal(t):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower())


def pack(pieces, most, sep):
    out, cur = [], ""
    for p in pieces:
        if cur and units(cur) + len(sep) + units(p) > most:
            out.append(cur)
            cur = p
        else:
            cur = cur + sep + p if cur else p
    return [*out, cur] if cur else out


def slices(t, most):
    out, cur = [], ""
    for c in t:
        if cur and units(cur) + units(c) > most:
            out.append(cur)
            cur = ""
        cur += c
    return [*out, cur] if cur else out


def chunks(t, most):
    paras = [p.strip(WS) for p in re.split(f"\n[{WS}]*\n", re.sub("\r\n?", "\n", t))]
    pieces = []
    for p in filter(None, paras):
        if units(p) > most:
            found = re.findall(f"[^.!?]*[.!?]+[{WS}]*|[^.!?]+\\Z", p)
            pieces += pack([x for f in found for x in slices(f, most)], most, "")
        else:
            pieces.append(p)
    return pack(pieces, most, "\n\n")


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expr).collect())]


TEXTS = s.lists(s.text(s.sampled_from(ALPHABET), max_size=60), min_size=30, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_against_models(spark, texts):
    t = F.col("t")
    assert column(spark, texts, tx.trim_all(t)) == [x.strip(WS) for x in texts]
    assert column(spark, texts, tx.units(t)) == [units(x) for x in texts]
    assert column(spark, texts, tx.approx_tokens(t)) == [-(-units(x) // 4) for x in texts]
    assert column(spark, texts, tx.fnv1a(t)) == [fnv(x) for x in texts]
    assert column(spark, texts, tx.normalize(t)) == [re.sub(" +", " ", normal(x)).strip(" ") for x in texts]
    for most in (2, 7, 20):
        found = column(spark, texts, ch.chunk_text(t, most))
        assert found == [chunks(x, most) for x in texts]
        assert all(units(c) <= most for f in found for c in f)
        assert column(spark, texts, tx.prefix(t, most)) == [(slices(x, most) or [""])[0] for x in texts]
        assert ["".join(x) for x in column(spark, texts, ch.hard_slices(t, most))] == texts


@pytest.mark.parametrize(
    ("text", "lengths"),
    [("aa\r\n\r\nbb\r\rcc", [10]), ("  \n\n ", []), ("x. " * 4000 + "\n\ntail", [7998, 4007]), ("a" * 3999 + "\n\n" + "b" * 3999, [8000]), ("a" * 3999 + "\n\n" + "b" * 4000, [3999, 4000]), ("a" * 8001, [8000, 1]), ("", [])],
)
def test_chunk_cases(spark, text, lengths):
    assert [len(c) for c in column(spark, [text], ch.chunk_text(F.col("t")))[0]] == lengths


def test_hand_cases(spark):
    assert column(spark, ["A b. C?! 3.14 x"], ch.sentences(F.col("t"))) == [["A b. ", "C?! ", "3.", "14 x"]]
    assert column(spark, ["", "a", "foobar"], tx.fnv1a(F.col("t"))) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert len(set(column(spark, ["C++", "C", "c."], tx.normalize(F.col("t"))))) == 1
    assert column(spark, ["/x/a.PDF", "b.tar.gz", ".env", "none", "c."], tx.extension(F.col("t"))) == [".pdf", ".gz", "", "", "."]
    assert column(spark, ["", " 3 ", "x", "true", "1e2"], tx.to_number(F.col("t"))) == [0.0, 3.0, None, 1.0, 100.0]
    assert column(spark, ['```json\n{"a":1}\n```', " {} ", "```\n[1]\n```"], tx.strip_fences(F.col("t"))) == ['{"a":1}', "{}", "[1]"]
