from __future__ import annotations

import random

import pytest

#: Columns whose names the operators use or add.
CLASHES = ("fingerprint", "component_id", "n_tokens", "ids", "score", "held_out", "_uid", "n_words", "hash", "item", "own_0", "_digest", "r", "quality_", "c", "e")

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 8))) for _ in range(n))


def edge_texts() -> list[str | None]:
    """Nulls, empty, blank, short, long, unbroken and repeated texts, and those of other scripts."""
    rng = random.Random(7)
    long = sentence(rng, 4000)
    same = sentence(rng, 60)
    return [None, "", "   \n\t", "a", "Word", same, same, same + " end", same.upper(), "x" * 30_000, long, long, "日本語 のテキスト 😀 çà et là́", "it's we'll  don't\r\n\r\n 'x'  1234  \x00\x1f", "<|endoftext|> in text", "na " * 300, None]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i if i % 6 else None, t, [None, "en", "de"][i % 3], None, *["z"] * len(CLASHES)) for i, t in enumerate(edge_texts())]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))




@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def by_row(df, *key):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[k] for k in key) for r in df.collect()), key=lambda t: [(v is not None, v) for v in t])
