"""The queries of this subpackage, thin layers over its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at four or fewer differing bits."""
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 or more words removed: digests of what is left."""
    from .substring import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    from .decontaminate import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back: digests of both."""
    from .bpe import decode, encode

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    coded = encode(_table(spark, sf_dir, "documents"), ranks).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(coded, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a digest cache, which starts empty here."""
    from .common import shared_dir
    from .token_counts import count_tokens

    counts = count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text."""
    from .quality import score

    scored = score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence files written and read back."""
    from .arrow_output import read_sequences, write_sequences
    from .common import shared_dir

    docs, folder = _table(spark, sf_dir, "documents"), shared_dir(spark, "sequences")
    files = write_sequences(docs, folder, _tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)
    found = read_sequences(spark, folder, files, docs.schema["doc_id"].dataType)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_main_text": op2_main_text,
    "op3_nearest": op3_nearest,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_decontaminate": op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_arrow_sequences": op10_arrow_sequences,
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {"op3_nearest": ann.SQL, "op5_substring": substring.SQL, "op6_decontaminate": decontaminate.SQL}
