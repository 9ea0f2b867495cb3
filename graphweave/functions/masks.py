"""Taint kinds as bits of an integer: union is |, clearing is & ~."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of taint, by bit.
KINDS = ["sql", "html", "shell", "path", "url", "js", "header", "ldap", "xpath", "log", "code", "mass_assign"]
ALL = (1 << len(KINDS)) - 1


def mask(*kinds: str) -> int:
    return sum(1 << KINDS.index(k) for k in kinds)


def cleared(taint: Column, by: Column) -> Column:
    return taint.bitwiseAND(F.bitwise_not(by))


def union(taint: Column) -> Column:
    """Aggregate: kinds of any row, 0 for none."""
    return F.coalesce(F.bit_or(taint), F.lit(0))
