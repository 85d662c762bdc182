"""Word sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is a run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words of the whole text in order; null text gives no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    """The distinct words as sorted hashes."""
    return F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))


def word_bag(text: Column) -> Column:
    """All words as sorted hashes; the second, third .. copy of a word is another element."""
    ordered = F.array_sort(words(text))
    copies = F.transform(ordered, lambda w, i: F.xxhash64(w, i - F.array_position(ordered, w)))
    return F.array_sort(copies)


def overlap(a: str, b: str) -> Column:
    """Number of common elements of two sets."""
    return F.size(F.array_intersect(a, b))
