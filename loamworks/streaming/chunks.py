"""Documents that arrive continuously.

Chunking needs no state, so it runs on a stream as on a table.  Combination is
incremental: each micro-batch of pairs is united with what is stored, as the
combination of packages is with an earlier result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import CHUNK_UNITS, chunk_documents
from ..operators.dedupe import unique_pairs
from ..operators.split import with_split


def chunk_stream(docs: DataFrame, path: str, checkpoint: str, most: int = CHUNK_UNITS) -> StreamingQuery:
    """Chunks of a stream of documents (source, text), appended as Parquet."""
    return chunk_documents(docs, most).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def combine_stream(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Unique pairs of a stream (instruction, output, source, chunk): each batch adds the keys that are new, first ones stay.

    A batch has its own folder, so one that runs again replaces what it wrote.
    """
    columns = ["instruction", "output", "source", "chunk", "pair_key", "split"]

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = with_split(unique_pairs(batch.withColumn("_ord", F.monotonically_increasing_id()), ["_ord"])).select(*columns)
        old = batch.sparkSession.read.schema(fresh.schema).option("recursiveFileLookup", "true").parquet(path) if batch_id and _exists(batch, path) else None
        if old is not None:
            earlier = old.where(~F.input_file_name().contains(f"/batch={batch_id}/")).select("pair_key")
            fresh = fresh.join(earlier, "pair_key", "left_anti").select(*columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pairs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)
