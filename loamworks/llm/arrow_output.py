"""Token ids as Arrow stream files of equal-length sequences.

All documents' ids, each document followed by an end id, form one stream in
ascending doc_id order.  The stream is cut into shards (ranges of doc_id), each
written as one or more Arrow stream files of record batches with the columns
``input_ids`` fixed_size_list<uint16 or uint32>[L] and ``mask``
fixed_size_list<bool>[L], uncompressed, so that a reader maps a file and takes
sequence i by arithmetic alone.  Only the last sequence of a file is padded
(mask 0).  A file's metadata says which documents it holds.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .tokenizer_file import load

ROWS_PER_BATCH = 512
FILE_IDS = 4 << 20
OWN = b"documents"


def _batch(ids: np.ndarray, length: int, schema: pa.Schema) -> pa.RecordBatch:
    """Whole sequences; the last is padded if the ids end within it."""
    rows = -(-len(ids) // length)
    padded, mask = np.zeros(rows * length, ids.dtype), np.zeros(rows * length, bool)
    padded[: len(ids)], mask[: len(ids)] = ids, True
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)


def write_stream(sink: io.IOBase | pa.NativeFile, ids: np.ndarray, length: int, documents: pa.RecordBatch, shard: int, offset: int) -> None:
    """One stream file, a batch at a time; its schema's metadata holds its documents (doc_id, n_tokens) and its place."""
    note = io.BytesIO()
    with pa.ipc.new_stream(note, documents.schema) as out:
        out.write_batch(documents)
    kind = pa.from_numpy_dtype(ids.dtype)
    schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={OWN: note.getvalue(), b"shard": str(shard).encode(), b"offset": str(offset).encode()})
    with pa.ipc.new_stream(sink, schema) as out:
        for k in range(0, len(ids), ROWS_PER_BATCH * length):
            out.write_batch(_batch(ids[k : k + ROWS_PER_BATCH * length], length, schema))


class StreamFile:
    """Random access to the sequences of a stream file, without copies."""

    def __init__(self, data: bytes | pa.Buffer):
        reader = pa.ipc.open_stream(pa.py_buffer(data) if isinstance(data, bytes) else data)
        self.schema = reader.schema
        self.batches = list(reader)
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    @property
    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self.schema.metadata[OWN]).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i, views of the file's bytes."""
        k = int(np.searchsorted(self.ends, i, "right"))
        batch, row = self.batches[k], i - int(self.ends[k - 1] if k else 0)
        length = batch.schema.field(0).type.list_size
        ids, mask = (batch.column(c).flatten().slice(row * length, length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self) -> np.ndarray:
        """All ids that the mask holds, in order."""
        parts = []
        for b in self.batches:
            ids, mask = b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()
            parts.append(ids if mask.true_count == len(ids) else ids[mask.to_numpy(zero_copy_only=False)])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("n_ids", T.LongType())])


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, *, length: int = 1024, end_id: int = 0, small_ids: bool = True, file_ids: int = FILE_IDS) -> DataFrame:
    """Write documents (doc_id, text) as stream files to ``folder``; returns the files' table (file, shard, n_ids).

    Documents are dealt by ranges of doc_id and a digest of the text, and sorted
    by both (null ids first), encoded, ended by ``end_id`` and packed end to
    end.  A document lies within one file; a file is closed once it holds
    ``file_ids`` ids, and padded.  A null or empty text gives the end id alone; no
    documents give no files.  ``folder`` is any URI that Arrow's file systems
    open.  A task that runs again writes other files; only those in the
    returned table count.  ``small_ids``: 16 bits an id, for vocabularies of up
    to 65,536.
    """
    dtype = np.dtype(np.uint16 if small_ids else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        shard, coder = TaskContext.get().partitionId(), load(tokenizer_path)
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = offset = 0

        def close() -> pa.RecordBatch:
            nonlocal held, offset
            documents = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.concatenate(ends))], names=["doc_id", "n_tokens"])
            name = f"{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(f"{path}/{name}") as out:
                write_stream(out, np.concatenate(ids), length, documents, shard, offset)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), pa.array([held], pa.int64())], names=FILES.names)
            offset, held = offset + held, 0
            for x in (ids, ends, keys):
                x.clear()
            return row

        for batch, texts in slices(batches, "text", min(file_ids, 1 << 18)):
            if not keys:
                store.create_dir(path, recursive=True)
            own, counts = coder.encode(texts)
            if small_ids and len(own) and int(own.max()) > 65535:
                raise ValueError("ids over 65535 need small_ids=False")
            full = np.insert(own.astype(dtype), np.cumsum(counts), end_id)
            ids.append(full)
            ends.append(counts + 1)
            keys.append(batch.column("doc_id"))
            held += len(full)
            if held >= file_ids:
                yield close()
        if keys:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, FILES), "sequence-files")


def read_sequences(spark: SparkSession, folder: str, files: DataFrame, doc_id_type: T.DataType) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the documents in the files that ``files`` names.

    ``start`` counts the ids of all documents before it in the whole stream;
    ``ids``: the document's ids with its end id, unsigned 32-bit little-endian.
    """
    rows = T.StructType([T.StructField("doc_id", doc_id_type), T.StructField("_file", T.StringType()), T.StructField("_shard", T.IntegerType()), T.StructField("_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                file = StreamFile(content.as_buffer())
                ids, documents = file.ids(), file.documents.combine_chunks()
                counts = documents.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                shard, offset = (int(file.schema.metadata[k]) for k in (b"shard", b"offset"))
                keys, name = documents.column("doc_id").combine_chunks(), path.as_py().rpartition("/")[2]
                for a in range(0, len(counts), 256):
                    b = min(a + 256, len(counts))
                    first = int(ends[a] - counts[a])
                    sizes = np.concatenate([[0], ends[a:b] - first]).astype(np.int32) * 4
                    own = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(sizes), pa.py_buffer(ids[first : int(ends[b - 1])].astype("<u4").tobytes())])
                    n = b - a
                    yield pa.RecordBatch.from_arrays([keys.slice(a, n), pa.array([name] * n), pa.array([shard] * n, pa.int32()), pa.array(offset + ends[a:b] - counts[a:b]), pa.array(counts[a:b]), own], names=rows.names)

    if not files.take(1):
        empty = spark.createDataFrame([], rows)
        return empty.select("doc_id", F.col("_offset").alias("start"), "n_tokens", "ids")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("path", "content")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    named = files.join(shards, "shard").select(F.col("file").alias("_file"), "_base")
    found = content.mapInArrow(run, rows)
    return found.join(named, "_file").select("doc_id", (F.col("_base") + F.col("_offset")).alias("start"), "n_tokens", "ids")
