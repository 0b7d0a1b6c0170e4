"""Text of document files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Raw text of a word-processor file: each paragraph followed by an empty line."""
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        root = ElementTree.fromstring(held.read("word/document.xml"))
    out = []
    for paragraph in root.iter(f"{_W}p"):
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                out.append(node.text or "")
            elif node.tag == f"{_W}tab":
                out.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        out.append("\n\n")
    return "".join(out)


def pdf_text(content: bytes) -> str:
    """Text of a PDF, if a library for it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed; pass an extractor for .pdf") from e
    return "".join(f"\n\n{page.extract_text()}" for page in PdfReader(io.BytesIO(content)).pages)


PACKAGE = "Packages of datasets (.zip) are combined, not extracted."
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}


def extract_text(spark: SparkSession, paths: list[str] | str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Rows (path, source, text, error) of files, each path once; one that can't be read, or is of another kind, has an error and no text."""
    paths = paths if isinstance(paths, str) else list(dict.fromkeys(paths))
    known = {**EXTRACTORS, **(extractors or {})}
    files = spark.read.format("binaryFile").load(paths).select("path", base_name(F.col("path")).alias("source"), extension(F.col("path")).alias("ext"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors = [], []
            for ext, content in zip(part["ext"], part["content"], strict=True):
                text = error = None
                try:
                    if ext not in known:
                        raise ValueError(PACKAGE if ext == ".zip" else f"Unsupported file type: {ext}")
                    text = known[ext](content)
                except Exception as e:  # becomes a row
                    error = str(e) or type(e).__name__
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": part["path"], "source": part["source"], "text": texts, "error": errors})

    return files.mapInPandas(run, "path string, source string, text string, error string")
