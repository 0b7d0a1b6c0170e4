"""First-wins removal of duplicates, and the union of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, pair_key


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The earliest row of each key.

    The rank filter becomes a group limit before the shuffle, so a key with many
    rows sends one a partition.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def unique_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Pairs (instruction, output, ...) that differ in more than case, punctuation and spacing; keeps their key as ``pair_key``."""
    keyed = pairs.withColumn("pair_key", pair_key(F.col("instruction"), F.col("output")))
    return first_wins(keyed, F.col("pair_key"), order)


def unique_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks (text, ...) that differ in more than case, punctuation and spacing."""
    return first_wins(chunks, normalize(F.col("text")), order)


def union_datasets(*datasets: DataFrame) -> DataFrame:
    """All rows, with ``file_ord`` telling which dataset they come from."""
    return reduce(DataFrame.unionByName, (d.withColumn("file_ord", F.lit(i)) for i, d in enumerate(datasets)))
