"""Patterns from word lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(words: list[str]) -> str:
    """One alternation that matches any of the words literally."""
    return "|".join(re.sub(r"([^A-Za-z0-9_/%: -])", r"\\\1", w) for w in words)


def has_any(c: Column, words: list[str]) -> Column:
    """True if lower-cased ``c`` contains any word; false for null."""
    return F.coalesce(F.lower(c).rlike(quoted([w.lower() for w in words])), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
