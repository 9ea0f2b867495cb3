"""Glob and severity helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from least to greatest.
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def glob_pattern(glob: str) -> str:
    """An anchored regular expression; ``*`` and ``?`` cross slashes."""
    return "^(?s:" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + ")$"


def glob_column(glob: Column) -> Column:
    """As ``glob_pattern``, for a column of globs: every character but letters, digits and the two wildcards is escaped."""
    escaped = F.regexp_replace(glob, r"([^\p{L}\p{N}*?])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(")$"))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(0), F.least(F.lit(len(SEVERITIES) - 1), rank)).cast("int") + 1)


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole to 6 places, 1.0 where there is nothing to count."""
    return F.round(F.when(whole == 0, F.lit(1.0)).otherwise(F.try_divide(part, whole)), 6)
