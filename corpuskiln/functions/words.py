"""Word-level column expressions (a word: a run of ASCII letters and digits, lower-cased)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_words(text: Column | str) -> Column:
    """The words of `text` joined by single spaces; '' where there are none, null for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def with_shingles(df: DataFrame, words: str, into: str, size: int) -> DataFrame:
    """Add the distinct runs of `size` words of the normalised string column `words`; an empty array if it is shorter.

    The words are split in a projection of their own, so that the lambda reads
    an array and doesn't split the text anew for each run.
    """
    parts = F.col("_parts")
    last = F.size(parts) - F.lit(size - 1)
    run = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat_ws(" ", *[F.get(parts, i + k) for k in range(size)]))
    found = F.when(last >= 1, F.array_distinct(run)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_parts", F.split(words, " ")).withColumn(into, found).drop("_parts")


_TO_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def split_words(texts: Iterable[str | None]) -> list[list[bytes]]:
    """The words of each text, for use in Python workers; the same words as `normal_words` gives."""
    return [t.lower().encode("ascii", "replace").translate(_TO_WORDS).split() if t else [] for t in texts]
