"""Pairs: cleaning, tagging, and the output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all

#: The instruction of a training entry by mode, and of any other mode.
INSTRUCTIONS = {
    "knowledge-base": "Extract structured knowledge from the following document and return it as a JSON object.",
    "academic-research": "Analyze the following academic paper and extract structured research data, returning it as a JSON object.",
    "student-summary": "Summarize the following document for a student audience and return it as a JSON object.",
    "analytics": "Extract all significant data, metrics, trends, anomalies, and insights from the following document and return them as a JSON object.",
}
OTHER_INSTRUCTION = "Process the following document and return the result as a JSON object."


def clean(pairs: DataFrame) -> DataFrame:
    """Trimmed, without pairs that lack an instruction or an output."""
    trimmed = pairs.withColumns({c: F.coalesce(trim_all(F.col(c)), F.lit("")) for c in ("instruction", "output")})
    return trimmed.where("instruction <> '' AND output <> ''")


def to_alpaca(pairs: DataFrame) -> DataFrame:
    return pairs.select("instruction", F.lit("").alias("input"), "output", "source", "chunk")


def to_chat(pairs: DataFrame) -> DataFrame:
    def message(role: str, content: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    return pairs.select(F.array(message("user", "instruction"), message("assistant", "output")).alias("messages"))


def training_instruction(mode: str) -> str:
    return INSTRUCTIONS.get(mode, OTHER_INSTRUCTION)


def instruction_for(mode: Column) -> Column:
    found = F.lit(OTHER_INSTRUCTION)
    for name, text in INSTRUCTIONS.items():
        found = F.when(mode == name, text).otherwise(found)
    return found


def training_entries(docs: DataFrame) -> DataFrame:
    """(instruction, input, output) of documents (mode, text, result): the whole text, and the result as JSON text."""
    return docs.select(instruction_for(F.col("mode")).alias("instruction"), F.col("text").alias("input"), F.col("result").alias("output"))


def to_jsonl(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept, for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def preview(pairs: DataFrame, order: list[str], rows: int = 50) -> DataFrame:
    """The first pairs."""
    return pairs.orderBy(*order).limit(rows)
