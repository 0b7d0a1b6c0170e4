"""Packaged datasets: ZIP files of JSON lines, as a Spark data source.

``spark.read.format("zip_dataset").option("paths", json.dumps([...])).load()``
gives rows of every kind in one table; ``read_datasets`` takes it apart.  Each
file is one partition.  A file that can't be read whole gives a single row of
kind ``skipped`` and nothing else.
"""

from __future__ import annotations

import io
import json
import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_name, read_bytes, stem

#: The entries that hold pairs, in the order in which they are read.
PAIR_ENTRIES = ["alpaca.jsonl", "alpaca/train.jsonl", "alpaca/validation.jsonl"]
CHUNK_ENTRY = "chunks.jsonl"
#: Why a file is skipped.
NOT_A_ZIP = "not a valid ZIP file"
NO_PAIRS = "no training data inside"
#: ECMAScript white space and line ends.
JS_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # pair, chunk or skipped
        T.StructField("file_ord", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("entry_rank", T.IntegerType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("approx_tokens", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_lines(content: str) -> Iterator[tuple[int, dict]]:
    """(line number, object) of JSON lines; blank lines are skipped, a bad one raises.

    What isn't an object has no fields, but null can't be asked for any.
    """
    for n, line in enumerate(content.split("\n")):
        if line.strip(JS_SPACE):
            row = json.loads(line, parse_constant=_no_constant)
            if row is None:
                raise ValueError("null is not a record")
            yield n, row if isinstance(row, dict) else {}


def _whole(text: str) -> str:
    """Half surrogate pairs, which Spark strings can't hold, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def as_text(value: object) -> str:
    """A JSON value as a string, as JavaScript would write it."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, list):
        return ",".join(map(as_text, value))
    return "[object Object]" if isinstance(value, dict) else _whole(str(value))


def as_number(value: object) -> int | None:
    """A JSON value as a whole number; what isn't one is null."""
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, str):
        bare = value.strip(JS_SPACE)
        try:
            value = float(bare) if bare else 0.0
        except ValueError:
            return None
        if "_" in bare:
            return None
    if isinstance(value, list):
        return as_number(as_text(value))
    return int(value) if isinstance(value, float) and math.isfinite(value) and value.is_integer() else None


def _first(row: dict, *names: str, default: object) -> object:
    return next((row[n] for n in names if row.get(n) is not None), default)


def _bounded(value: int | None, bits: int) -> int | None:
    return value if value is not None and -(1 << bits - 1) <= value < 1 << bits - 1 else None


def read_dataset(path: str, file_ord: int) -> list[tuple]:
    """All rows of a file, or one that says why it is skipped."""
    name, fallback = file_name(path), stem(path)
    try:
        try:
            held = zipfile.ZipFile(io.BytesIO(read_bytes(path)))
        except zipfile.BadZipFile as e:
            raise ValueError(NOT_A_ZIP) from e
        entries = set(held.namelist())
        if not entries.intersection(PAIR_ENTRIES):
            raise ValueError(NO_PAIRS)
        rows = []
        for rank, entry in enumerate(PAIR_ENTRIES):
            if entry in entries:
                for n, row in parse_lines(held.read(entry).decode("utf-8", "replace")):
                    instruction, output = (as_text(row.get(c)).strip(JS_SPACE) for c in ("instruction", "output"))
                    if instruction and output:
                        rows.append(("pair", file_ord, name, rank, n, instruction, output, as_text(_first(row, "source", default=fallback)), _bounded(as_number(_first(row, "chunk", default=0)), 32), None, None, None))
        if CHUNK_ENTRY in entries:
            for n, row in parse_lines(held.read(CHUNK_ENTRY).decode("utf-8", "replace")):
                rows.append(("chunk", file_ord, name, 0, n, None, None, as_text(_first(row, "source", default=fallback)), _bounded(as_number(_first(row, "chunk", "id", default=0)), 32), as_text(row.get("text")), _bounded(as_number(_first(row, "approx_tokens", default=0)), 64), None))
        return rows
    except Exception as e:  # of any kind: the file is skipped, with the reason
        return [("skipped", file_ord, name, None, None, None, None, None, None, None, None, str(e) or type(e).__name__)]


@dataclass
class ZipPartition(InputPartition):
    path: str
    file_ord: int


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[ZipPartition]:
        return [ZipPartition(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: ZipPartition) -> Iterator[tuple]:
        yield from read_dataset(partition.path, partition.file_ord)


class ZipDatasets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_dataset"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZipReader(json.loads(self.options["paths"]))


def read_datasets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all files; a path that is listed twice is read twice."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(ZipDatasets)
    return spark.read.format("zip_dataset").option("paths", json.dumps(list(paths))).load()


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'pair'").select("instruction", "output", "source", "chunk", "file_ord", "entry_rank", "line_no")


def chunks_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'chunk'").select("source", "chunk", "text", "approx_tokens", "file_ord", "line_no")


def skipped_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'skipped'").select(F.col("file"), "reason", "file_ord")
