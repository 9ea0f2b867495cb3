"""Candidates for secrets in text, with their entropy, context and check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that can be keys and numbers that can be cards; their least entropy in bits a character; how far back the context goes.
TOKEN, DIGITS = r"[A-Za-z0-9_+/=-]{20,}", r"[0-9][0-9 -]{11,}[0-9]"
ENTROPY, CONTEXT = 3.0, 24
# Words before a value that call it a secret.
SAYS = "key|token|secret|passw|pwd|credential|auth|bearer|card|account"


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in the whole text with the characters before it: structs of ``value`` and ``context``."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    before = lambda i: F.lower(F.right(F.element_at(between, i + 1), F.lit(CONTEXT)))
    return F.transform(found, lambda v, i: F.struct(v.alias("value"), before(i).alias("context")))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character, to six places; 0 for the empty text."""
    letters = F.split(value, "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.greatest(F.length(value), F.lit(1))
    return F.round(F.aggregate(F.array_sort(F.array_distinct(letters)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))), 6)


def check_digit(digits: Column) -> Column:
    """Whether the last digit fits the others: every second one from the right but the last counts twice, its digits summed, and all add up to a multiple of ten."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x) % 10 == 0
