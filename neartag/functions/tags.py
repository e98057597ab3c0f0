"""Tag strings and tag arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(tags: Column) -> Column:
    """Distinct tags of a whitespace-separated string.

    Trailing blanks are ignored, a leading blank gives a leading empty tag, the empty
    string gives one empty tag and a string of blanks gives none.
    """
    trimmed = F.regexp_replace(tags, r"\s+$", "")
    return (F.when(tags == "", F.array(F.lit("")))
            .when(trimmed == "", F.array().cast("array<string>"))
            .otherwise(F.array_distinct(F.split(trimmed, r"\s+"))))


def join_tags(tags: Column) -> Column:
    """A tag array as one string, sorted, joined by single spaces."""
    return F.array_join(F.array_sort(tags), " ")
