"""Text normalisation and the similarity score of the fuzzy matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_SCORE = 90


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def comparable(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def closeness(distance: Column, longest: Column) -> Column:
    """``100 * (1 - distance / longest)`` rounded half up; 0 for empty texts."""
    whole = longest.cast("bigint")
    kept = (whole - distance) * 200 + whole
    return F.when(whole > 0, F.call_function("div", kept, whole * 2)).otherwise(F.lit(0).cast("bigint"))


def is_prefix_pair(a: Column, b: Column) -> Column:
    """One text starts with the other and is between 1.5 and 8 times as long."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    fits = (long * 2 >= short * 3) & (long <= short * 8)
    return (short > 0) & fits & (F.startswith(a, b) | F.startswith(b, a))


def similarity(a: Column, a_sorted: Column, b: Column, b_sorted: Column) -> Column:
    """Score from 0 to 100 of two comparable texts.

    The best of: edit distance relative to the longer text, the same with the
    words of both texts sorted, and a fixed score when one text is the
    beginning of a clearly longer one.
    """
    longest = F.greatest(F.length(a), F.length(b))
    nearest = F.least(F.levenshtein(a, b), F.levenshtein(a_sorted, b_sorted))
    prefix = F.when(is_prefix_pair(a, b), F.lit(PREFIX_SCORE)).otherwise(F.lit(0)).cast("bigint")
    return F.greatest(closeness(nearest, longest), prefix)
