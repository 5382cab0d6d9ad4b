"""Token arrays of normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import dictionaries as D


def words(text: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def one_letter(items: Column) -> Column:
    return F.filter(items, lambda w: F.length(w) == 1)


def longer(items: Column) -> Column:
    return F.filter(items, lambda w: F.length(w) > 1)


def word_tokens(text: Column) -> Column:
    """Runs of word characters (a hyphen cuts), each once."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\w]+"), lambda w: w != ""))


def joined(items: Column) -> Column:
    """All words written together if there are two or more, as a list of none or one."""
    return F.when(F.size(items) >= 2, F.array(F.concat_ws("", items))).otherwise(F.array().cast("array<string>"))


def generic(items: Column) -> Column:
    known = F.array(*[F.lit(w) for w in D.GENERIC_WORDS])
    return F.filter(items, lambda w: F.array_contains(known, w))


def brand(items: Column) -> Column:
    known = F.array(*[F.lit(w) for w in D.GENERIC_WORDS])
    return F.filter(items, lambda w: ~F.array_contains(known, w))
