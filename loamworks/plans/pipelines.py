"""The three pipelines: structured extraction, dataset generation, combination of datasets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import Accumulator, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_all
from ..operators import stats as st
from ..operators.chunking import CHUNK_UNITS, chunk_documents
from ..operators.dedupe import unique_chunks, unique_pairs
from ..operators.pairs import clean, training_instruction
from ..operators.split import with_split
from ..schemas import PAIRS_JSON_SCHEMA, REPLY_PAIRS, STRUCTURED
from ..sources import sinks
from ..sources.files import file_name
from ..sources.shared import stored
from ..sources.zip_datasets import chunks_of, pairs_of, read_datasets, skipped_of
from .extract import CONCURRENCY, Extractor, ask_all, mode_prompt, pairs_prompt

PAIR_ORDER = ["file_ord", "entry_rank", "line_no"]
CHUNK_ORDER = ["file_ord", "line_no"]
MADE_ORDER = ["source", "chunk", "pos"]


def extract_structured(docs: DataFrame, mode: str, make: Callable[[], Extractor], *, concurrency: int = CONCURRENCY) -> DataFrame:
    """Rows (source, text, status, reply, result, error) of documents (source, text): ``result`` has the mode's fields.

    A blank document isn't sent.  Replies of any shape are kept in ``reply``.
    """
    blank = trim_all(F.coalesce("text", F.lit(""))) == ""
    sent = ask_all(docs.where(~blank).select("source", "text", mode_prompt(mode, F.col("text")).alias("prompt")), make, schema=None, concurrency=concurrency)
    empty = docs.where(blank).select("source", "text", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("reply"), F.lit("The document has no text.").alias("error"))
    return sent.unionByName(empty).withColumn("result", F.from_json("reply", STRUCTURED[mode]))


@dataclass
class Dataset:
    """A generated dataset: chunks, pairs, statistics by source, and warnings."""

    chunks: DataFrame
    pairs: DataFrame
    stats: DataFrame
    warnings: DataFrame
    outcomes: DataFrame

    def summary(self, source: str) -> dict:
        """One source's statistics as one object."""
        row = self.stats.where(F.col("source") == source).drop("error").first()
        return {k: row[k] for k in ("source", "model", "created_at", "chunks", "pairs", "approx_source_tokens", "approx_dataset_tokens", "skipped_chunks")}

    def save(self, path: str, source: str) -> str:
        """One source's package."""
        of = F.col("source") == source
        return sinks.write_zip(path, sinks.dataset_entries(self.pairs.where(of), self.chunks.where(of), self.summary(source), MADE_ORDER))


def generate_dataset(docs: DataFrame, make: Callable[[], Extractor], *, model: str = "offline", most: int = CHUNK_UNITS, concurrency: int = CONCURRENCY, tasks: int | None = None, progress: Accumulator | None = None) -> Dataset:
    """Pairs from documents (source, text), of which each source is one.

    Chunks are dealt out evenly before they are sent.  A chunk with an empty
    list of pairs is processed; failed and unsent ones are skipped, and listed.
    A source without any pair has an ``error`` in its statistics.  ``progress``,
    an accumulator of the driver's, grows by one with each chunk that was tried.
    """
    chunks = stored(chunk_documents(docs, most), "chunks")
    prompts = chunks.select("source", "chunk", pairs_prompt(F.col("text")).alias("prompt"))
    outcomes = ask_all(prompts.repartition(tasks) if tasks else prompts.repartition("source", "chunk"), make, schema=PAIRS_JSON_SCHEMA, concurrency=concurrency, progress=progress)
    outcomes = stored(outcomes, "outcomes")  # no request is sent again, whatever becomes of its executor
    done = outcomes.where("status = 'ok'")
    made = done.select("source", "chunk", F.posexplode(F.from_json("reply", REPLY_PAIRS)["pairs"]).alias("pos", "p")).select("source", "chunk", "pos", "p.instruction", "p.output")
    pairs = clean(made)
    skipped = st.skipped_chunks(chunks, done)
    first = outcomes.where("status = 'failed'").groupBy("source").agg(F.min_by("error", "chunk").alias("first_error"))
    stats = st.dataset_stats(docs, chunks, pairs, skipped).join(first, "source", "left")
    nothing = F.coalesce("first_error", F.lit("The document gave no training pairs."))
    told = st.warnings(stats)
    stats = stats.withColumn("error", F.when(F.col("pairs") == 0, nothing)).drop("first_error")
    stats = stats.withColumns({"model": F.lit(model), "created_at": F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")})
    return Dataset(chunks, pairs, stats, told, outcomes)


def save(result: Dataset | Combined | DataFrame, path: str, kind: str, *, source: str | None = None) -> str:
    """A result as a package, by its kind: ``ai-data`` (one source of a dataset), ``combined``, or a structured mode (one document's row)."""
    if kind == "ai-data":
        return result.save(path, source)
    if kind == "combined":
        return result.save(path)
    row = result.where(F.col("source") == source).first() if source is not None else result.first()
    if row is None or row["status"] != "ok":
        raise ValueError(row["error"] if row else "There is nothing to save.")
    return sinks.write_zip(path, sinks.document_entries(json.loads(row["reply"]), row["text"], training_instruction(kind)))


@dataclass
class Combined:
    """Combined datasets: unique pairs with split, unique chunks, counts."""

    pairs: DataFrame
    chunks: DataFrame
    sources: DataFrame
    stats: DataFrame
    skipped: DataFrame
    files: int

    @property
    def train(self) -> DataFrame:
        return self.pairs.where("split = 'train'")

    @property
    def validation(self) -> DataFrame:
        return self.pairs.where("split = 'validation'")

    def summary(self) -> dict:
        """The statistics as one object: one count for each source and skipped file comes to the driver."""
        row = self.stats.first().asDict()
        return {
            "files": self.files,
            "sources": [{"source": r["source"], "pairs": r["pairs"]} for r in self.sources.orderBy("position").toLocalIterator()],
            **row,
            "skipped_files": [{"file": r["file"], "reason": r["reason"]} for r in self.skipped.orderBy("file_ord").toLocalIterator()],
        }

    def save(self, path: str) -> str:
        """A package, which the driver writes row by row."""
        return sinks.write_zip(path, sinks.combined_entries(self.pairs, self.chunks, self.summary(), PAIR_ORDER, CHUNK_ORDER))


def combine_tables(pairs: DataFrame, chunks: DataFrame, skipped: DataFrame, files: int, order: list[str] = PAIR_ORDER) -> Combined:
    """Of pairs and chunks that have ordinals: duplicates go, first ones stay, and the split is made."""
    unique = with_split(unique_pairs(pairs, order)).persist(StorageLevel.MEMORY_AND_DISK)
    ordinal = unique.withColumn("_ord", F.struct(*order))
    return Combined(unique, unique_chunks(chunks, CHUNK_ORDER), st.source_counts(ordinal, "_ord"), st.combined_stats(pairs, unique), skipped, files)


def combine(spark: SparkSession, paths: list[str], *, without: Iterable[str] = ()) -> Combined:
    """Of ZIP files; files that can't be read are skipped, and listed.

    A path counts once however often it is listed, and not at all if ``without``
    names it.  Files that aren't ZIP packages by name, and no pair at all, are
    errors.
    """
    dropped = set(without)
    paths = [p for p in dict.fromkeys(paths) if p not in dropped]
    if other := [p for p in paths if not p.lower().endswith(".zip")]:
        raise ValueError(f"Only .zip packages of generated datasets can be combined, not {file_name(other[0])}.")
    rows = read_datasets(spark, paths).persist(StorageLevel.MEMORY_AND_DISK)
    pairs, skipped = pairs_of(rows), skipped_of(rows)
    if not pairs.take(1):
        raise ValueError("None of these files hold training data.")
    return combine_tables(pairs, chunks_of(rows), skipped, len(paths) - skipped.count())
