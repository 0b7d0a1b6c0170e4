"""Bytes of files by path or URI."""

from __future__ import annotations


def read_bytes(path: str) -> bytes:
    """A whole file, of the local machine or of any store that Arrow's file systems open."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(path)
        with store.open_input_stream(own) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def file_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def stem(path: str) -> str:
    """Name without extension; a name that starts with its only dot has none."""
    name = file_name(path)
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name
