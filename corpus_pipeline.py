"""A corpus from raw documents to token ids: five stages, each one operator.

Quality classification, near-duplicate removal, removal of repeated passages,
benchmark decontamination and byte-level BPE.  Every stage takes (spark, docs,
sf_dir), works on all that its predecessor kept and, but for the last, returns
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm.bpe import encode
from loamworks.llm.common import stored
from loamworks.llm.decontaminate import decontaminate
from loamworks.llm.quality import score
from loamworks.llm.simhash import representatives
from loamworks.llm.substring import remove_repeats

LEAST_QUALITY = 0.3


def _apart(docs: DataFrame) -> DataFrame:
    """Columns other than doc_id and text under names that no operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"own_{c}") for c in docs.columns))


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"`{c}`" if c in ("doc_id", "text") else f"`own_{c}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those without any text to judge are kept."""
    own = _apart(docs)
    scored = score(own, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(own.columns))
    return _back(scored.where(F.col("score") >= LEAST_QUALITY), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest id, rows without id last, and of equal ids the least text hash (equal texts: any)."""
    own = _apart(docs).withColumn("digest", F.xxhash64("text"))
    kept = stored(representatives(own), "kept")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # rows that this makes equal have one text, so one of them stays
    wanted = kept.select(F.coalesce(F.col("kept_id").cast("string"), F.lit("")).alias("id_key"), F.col("kept_digest").alias("digest"))
    out = own.withColumn("id_key", key).join(wanted.hint("shuffle_hash"), ["id_key", "digest"], "left_semi")  # ids grow with the documents: never broadcast
    return _back(out.dropDuplicates(["id_key", "digest"]), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 or more words that occur elsewhere."""
    found = remove_repeats(_apart(docs))
    if "n_chars" in docs.columns:
        own = docs.schema["n_chars"].dataType
        found = found.withColumn("own_n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(own)).otherwise(F.col("own_n_chars")))
    return _back(found, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents: (doc_id, n_tokens, ids)."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
