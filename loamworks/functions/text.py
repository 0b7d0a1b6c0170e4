"""Text functions with the semantics of UTF-16 strings, as Column expressions.

Lengths and cuts count 16-bit units.  Spark's strings can't hold half of a
surrogate pair, so a cut that would split one moves back by one unit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ECMAScript takes for white space and line ends.
WS = r"[\u0009-\u000D \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_SIGNS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Fixed values of 32-bit FNV-1a.
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193
#: So few rows are no longer worth arrays.
FNV_FEW = 8


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WS_SIGNS))


def units(text: Column) -> Column:
    """Length in 16-bit units, an int."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def prefix(text: Column, most: int) -> Column:
    """The first ``most`` units."""
    coded = F.encode(text, "UTF-16BE")
    first = F.hex(F.substring(coded, 2 * most - 1, 1))  # of the last unit that is kept
    cut = F.when(first.between("D8", "DB"), 2 * (most - 1)).otherwise(2 * most)
    return F.when(units(text) <= most, text).otherwise(F.decode(F.substring(coded, F.lit(1), cut), "UTF-16BE"))


def approx_tokens(text: Column) -> Column:
    """A quarter of the units, rounded up."""
    return F.ceil(units(text) / 4).cast("long")


def normalize(text: Column) -> Column:
    """Lower case, letters and digits only, one space for what was between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pair_key(instruction: Column, output: Column) -> Column:
    """What makes a pair unique."""
    return F.concat_ws("\n", normalize(instruction), normalize(output))


def _fnv1a(texts: pd.Series) -> pd.Series:
    """A unit of all rows at a time, those of the few longest one by one."""
    own = [t.encode("utf-16-le", "surrogatepass") for t in texts.fillna("")]
    sizes = np.array([len(o) // 2 for o in own], np.int64)
    order = np.argsort(-sizes, kind="stable")  # rows that end later come first
    units_, begins = np.frombuffer(b"".join(own), np.uint16), (np.cumsum(sizes) - sizes)[order]
    sorted_sizes, hashes = sizes[order], np.full(len(own), FNV_START, np.uint32)
    j, active = 0, int((sizes > 0).sum())
    while active > FNV_FEW:
        hashes[:active] = (hashes[:active] ^ units_[begins[:active] + j]) * np.uint32(FNV_PRIME)
        j += 1
        while active and sorted_sizes[active - 1] <= j:
            active -= 1
    for r in range(active):
        h = int(hashes[r])
        for u in units_[begins[r] + j : begins[r] + sorted_sizes[r]].tolist():
            h = (h ^ u) * FNV_PRIME & 0xFFFFFFFF
        hashes[r] = h
    out = np.empty(len(own), np.int64)
    out[order] = hashes
    return pd.Series(out).astype("Int64").where(texts.notna().reset_index(drop=True))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over 16-bit units, a long without sign."""
    return F.pandas_udf(_fnv1a, "long")(text)


def strip_fences(text: Column) -> Column:
    """A reply without the code fence around it: the first opening fence, then the first fences at a line's start and end."""
    once = text
    for pattern in (rf"(?m)^```json{WS}*", rf"(?m)^```{WS}*", rf"(?m){WS}*```$"):
        once = F.regexp_replace(once, rf"(?s)\A(.*?){pattern}(.*)\z", "$1$2")
    return trim_all(once)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none (names that start with their only dot have none)."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def stem(path: Column) -> Column:
    """Base name without extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def to_number(value: Column) -> Column:
    """A string as a JavaScript number would read it: empty is 0, what is no number is null."""
    bare = trim_all(value)
    return F.when(bare == "", F.lit(0.0)).when(bare == "true", 1.0).when(bare == "false", 0.0).otherwise(bare.try_cast("double"))
