"""Similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a task (fixed values).
STOP_WORDS = ("및", "의", "을", "를", "이", "가", "에", "로", "으로", "와", "과", "에서", "부터", "까지")


def dot(a: Column, b: Column) -> Column:
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def letter_counts(text: Column) -> Column:
    """How often a text has each letter from a to z: a vector that stands in for one of an embedding model."""
    low = F.lower(text)
    return F.transform(F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"]), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of the sets of characters; 0 if one is empty."""
    chars = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    both, either = F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def core_words(x: Column) -> Column:
    """What "및" joins in a name whose blanks are taken out, without stop words."""
    y = F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("및"), F.lit(" "))
    return F.array_distinct(F.filter(F.split(y, r"(?U)\s+"), lambda w: ~w.isin("", *STOP_WORDS)))


def core_words_agree(a: Column, b: Column) -> Column:
    """Whether at least one core word, and half of the smaller set, is common."""
    common, least = F.size(F.array_intersect(core_words(a), core_words(b))), F.least(F.size(core_words(a)), F.size(core_words(b)))
    return (common >= 1) & (common >= 0.5 * least)


def action(similarity: Column, merge: float = 0.90, review: float = 0.80) -> Column:
    return F.when(similarity >= merge, "merge").when(similarity >= review, "review").otherwise("create")
