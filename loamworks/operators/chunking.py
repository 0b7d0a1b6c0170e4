"""Segmentation of texts into chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, approx_tokens, trim_all, units

CHUNK_UNITS = 8000


def paragraphs(text: Column) -> Column:
    """Trimmed parts between empty lines, without empty ones."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(lines, rf"\n{WS}*\n", -1)
    return F.filter(F.transform(parts, trim_all), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Parts that end at a run of ``.!?`` with the white space after it; together they are the paragraph."""
    return F.regexp_extract_all(paragraph, F.lit(rf"([^.!?]*[.!?]+{WS}*|[^.!?]+\z)"))


def hard_slices(text: Column, most: int) -> Column:
    """Parts of ``most`` units, the last one shorter; surrogate pairs stay whole."""
    plain = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    empty = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("c"), F.lit(0).alias("n"))

    def add(state: Column, char: Column) -> Column:
        size = units(char)
        full = state["n"] + size > most
        return F.struct(
            F.when(full, F.concat(state["o"], F.array(state["c"]))).otherwise(state["o"]).alias("o"),
            F.when(full, char).otherwise(F.concat(state["c"], char)).alias("c"),
            F.when(full, size).otherwise(state["n"] + size).alias("n"),
        )

    wide = F.aggregate(F.split(text, ""), empty, add, lambda s: F.concat(s["o"], F.array(s["c"])))
    return F.when(units(text) <= most, F.array(text)).when(units(text) == F.length(text), plain).otherwise(wide)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pack(pieces: Column, most: int, separator: str) -> Column:
    """Neighbouring pieces joined by the separator as long as they stay within ``most`` units."""
    gap = len(separator)
    start = F.struct(F.array().cast("array<int>").alias("o"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def add(state: Column, size: Column) -> Column:  # numbers only: where chunks begin, after the first
        full = (state["n"] > 0) & (state["n"] + gap + size > most)
        return F.struct(
            F.when(full, F.concat(state["o"], F.array(state["i"]))).otherwise(state["o"]).alias("o"),
            F.when(full | (state["n"] == 0), size).otherwise(state["n"] + gap + size).alias("n"),
            (state["i"] + 1).alias("i"),
        )

    def cut(own: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.aggregate(F.transform(own, units), start, add, lambda s: s["o"]))
        return _bound(F.struct(begins.alias("b"), F.size(own).alias("n")), join(own))

    def join(own: Column):
        def parts(x: Column) -> Column:
            after = lambda i: F.coalesce(F.get(x["b"], i + 1), x["n"])
            return F.transform(x["b"], lambda b, i: F.array_join(F.slice(own, b + 1, after(i) - b), separator))

        return parts

    return _bound(pieces, lambda own: F.when(F.size(own) > 0, cut(own)).otherwise(F.array().cast("array<string>")))


def split_long(paragraph: Column, most: int) -> Column:
    """A paragraph at sentence ends, and within sentences that are too long; the pieces are packed again."""
    return pack(F.flatten(F.transform(sentences(paragraph), lambda s: hard_slices(s, most))), most, "")


def chunk_text(text: Column, most: int = CHUNK_UNITS) -> Column:
    """The chunks of a text: an array of strings, none longer than ``most`` units."""
    pieces = F.transform(paragraphs(text), lambda p: F.when(units(p) > most, split_long(p, most)).otherwise(F.array(p)))
    return pack(F.flatten(pieces), most, "\n\n")


def chunk_documents(docs: DataFrame, most: int = CHUNK_UNITS, *, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Rows (*by, chunk, text, approx_tokens), chunks counted from 1; documents are cut each for itself, without a shuffle."""
    cut = docs.select(*by, F.posexplode(chunk_text(F.col("text"), most)).alias("pos", "text"))
    return cut.select(*by, (F.col("pos") + 1).alias("chunk"), "text", approx_tokens(F.col("text")).alias("approx_tokens"))
