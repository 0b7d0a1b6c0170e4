"""Encoding with tokenizer files of public libraries (.json tokenizers, .model sentencepiece)."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .bpe import Encoder, Vocabulary


class LibraryEncoder:
    """The library that the file's ending names, on whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        parts = self._encode(texts)
        return np.array([i for p in parts for i in p], np.int32), np.fromiter(map(len, parts), np.int64, len(parts))


class PieceEncoder:
    """What the tokenizers library gives for plain byte-level BPE files, from cached pieces.

    The library encodes about a megabyte a second and core; this is several
    times faster on texts whose words recur.  Special strings split a text
    first, as in the library; the parts between them are cut into pre-tokens by
    the scan of ``bpe``, and each piece that is not cached is merged.
    """

    def __init__(self, spec: dict):
        self.coder = Encoder(byte_level_vocabulary(spec))
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pattern = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split = re.compile(f"({pattern})") if pattern else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        if not self.split or not any(s in t for s in self.special for t in texts):
            return self.coder.encode(texts)[:2]
        parts = [self.split.split(t) for t in texts]
        ids, counts = self.coder.encode([x for p in parts for x in p[::2]])[:2]
        plain = iter(np.split(ids, np.cumsum(counts)[:-1]))
        out, sizes = [], []
        for p in parts:
            own = [np.array([self.special[x]], np.int32) if k % 2 else next(plain) for k, x in enumerate(p)]
            sizes.append(sum(map(len, own)))
            out += own
        return np.concatenate(out), np.array(sizes, np.int64)


def byte_level_vocabulary(spec: dict) -> Vocabulary:
    """The ranks and merges in a byte-level file, whose tokens show each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {a["content"] for a in spec["added_tokens"]}
    raw = {token: bytes(byte[c] for c in token) for token in spec["model"]["vocab"] if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Vocabulary({raw[token]: rank for token, rank in spec["model"]["vocab"].items() if token in raw}, [(raw[a], raw[b]) for a, b in merges])


def is_plain_byte_level(spec: dict) -> bool:
    """Whether PieceEncoder gives what the library would: byte-level BPE alone, whose merges follow the ids."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
        return False
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(a < b for a, b in zip(merged, merged[1:], strict=False))


_loaded: dict[str, LibraryEncoder | PieceEncoder] = {}


def load(path: str) -> LibraryEncoder | PieceEncoder:
    """This worker's encoder for a file, kept from task to task."""
    if path not in _loaded:
        spec = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
        _loaded.clear()
        _loaded[path] = PieceEncoder(spec) if spec and is_plain_byte_level(spec) else LibraryEncoder(path)
    return _loaded[path]
