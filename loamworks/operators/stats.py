"""Counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from ..sources.shared import shared_dir


def pair_tokens() -> Column:
    """Tokens of a pair, rounded for each pair."""
    return approx_tokens(F.concat("instruction", "output"))


def source_counts(pairs: DataFrame, order: str) -> DataFrame:
    """(source, pairs, position): pairs of each source, sources in the order of their first pair.

    Sources are dealt out by ranges; what comes before a range is a sum over ranges.
    """
    spark = pairs.sparkSession
    counted = pairs.groupBy("source").agg(F.count("*").alias("pairs"), F.min(order).alias("_first"))
    path = shared_dir(spark, "source-counts")
    counted.repartitionByRange("_first").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_first"))
    return ranged.withColumn("_row", within).join(ranges, "_range").select("source", "pairs", (F.col("_before") + F.col("_row")).cast("int").alias("position"))


def combined_stats(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: pairs, duplicates_removed, train, validation, approx_tokens (``unique`` has split)."""
    total = pairs.agg(F.count("*").alias("total"))
    own = unique.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
        F.coalesce(F.sum(pair_tokens()), F.lit(0)).alias("approx_tokens"),
    )
    both = own.crossJoin(total)  # of one row each
    return both.select("pairs", (F.col("total") - F.col("pairs")).alias("duplicates_removed"), "train", "validation", "approx_tokens")


def skipped_chunks(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """Chunks (source, chunk, ...) without an outcome among ``processed`` (source, chunk)."""
    return chunks.join(processed.select("source", "chunk"), ["source", "chunk"], "left_anti")


def dataset_stats(docs: DataFrame, chunks: DataFrame, pairs: DataFrame, skipped: DataFrame) -> DataFrame:
    """A row for each source of ``docs``: chunks, pairs, approx_source_tokens (of the raw texts), approx_dataset_tokens, skipped_chunks."""
    own = docs.groupBy("source").agg(F.sum(approx_tokens(F.col("text"))).alias("approx_source_tokens"))
    cut = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    made = pairs.groupBy("source").agg(F.count("*").alias("pairs"), F.sum(pair_tokens()).alias("approx_dataset_tokens"))
    left = skipped.groupBy("source").agg(F.sort_array(F.collect_list("chunk")).alias("skipped_chunks"))
    all_ = own.join(cut, "source", "left").join(made, "source", "left").join(left, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chunks", "pairs", "approx_source_tokens", "approx_dataset_tokens")}
    none = F.coalesce("skipped_chunks", F.array().cast("array<int>")).alias("skipped_chunks")
    return all_.select("source", *(zero[c].alias(c) for c in zero), none)


def warnings(stats: DataFrame) -> DataFrame:
    """(source, warning) of the sources that have skipped chunks; ``first_error`` says why the first of them failed."""
    left = F.size("skipped_chunks")
    count = F.concat(left.cast("string"), F.lit(" of "), F.col("chunks").cast("string"), F.lit(" chunks have no training data because they could not be processed."))
    text = F.concat_ws(" ", count, F.col("first_error"))
    return stats.where(left > 0).select("source", text.alias("warning"))
