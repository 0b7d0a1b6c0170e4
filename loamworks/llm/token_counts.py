"""Token counts through a cache keyed by digests.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).  A
run joins the digests of its texts to it, encodes each distinct missing content
once, appends those counts, and joins all documents to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .tokenizer_file import load

CACHE = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    """Names the version: any change of the file is another tokenizer."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; an empty table where none have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(model.encode(texts)[1], pa.int64())], names=["content_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens) of documents (doc_id, text); new counts are appended to the cache.

    Content is normalised as the tokenizer itself sees it: a null text is the
    empty text, nothing else changes, since anything more could change counts.
    Each distinct missing text is encoded once, however often it occurs.  One
    row for each input row; an empty text has no tokens; texts may be of any
    length; further columns are ignored.  Appending a count twice (a job run
    again) does no harm: of several counts of a content the least is taken.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def known() -> DataFrame:
        return read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))

    distinct = keyed.groupBy("content_digest").agg(F.first("text").alias("text"))  # partial: each task sends a text once
    missing = distinct.join(known(), "content_digest", "left_anti")
    counted = missing.mapInArrow(_counting(tokenizer_path), T.StructType([CACHE["content_digest"], CACHE["n_tokens"]]))
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = stored(known(), "known-counts")  # a table, so that a content with many copies can be split in the join
    return keyed.select("doc_id", "content_digest", "n_bytes").join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")
