"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: ASCII white space, the separators of words in all contracts.
WORD_GAP = r"[\x20\x09-\x0D]+"


__all__ = ["WORD_GAP", "discard", "held_out", "shared_dir", "slices", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from (null ids are learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that the texts of each hold about ``most`` characters (a longer text stands alone), null as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
