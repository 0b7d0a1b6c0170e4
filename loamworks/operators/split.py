"""Training and validation sets by a stable hash of a pair's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a

VALIDATION_PERCENT = 10


def is_validation(key: Column) -> Column:
    """Depends on the pair alone, so a pair stays where it is when data are added."""
    return fnv1a(key) % 100 < VALIDATION_PERCENT


def with_split(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with pair_key) and a column ``split``."""
    return pairs.withColumn("split", F.when(is_validation(F.col("pair_key")), "validation").otherwise("train"))
