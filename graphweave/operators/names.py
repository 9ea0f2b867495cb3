"""Names that a slip of two letters turns into each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(name: Column, most: int) -> Column:
    """The distinct texts that ``name`` becomes by leaving out up to ``most`` of its characters, itself included."""
    out = F.array(name)
    for _ in range(most):
        once = F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        out = F.array_distinct(F.concat(out, F.flatten(once)))
    return out


def near_names(names: DataFrame, most: int = 2) -> DataFrame:
    """``name, other, distance`` of all pairs of different ``name`` (the lesser first) within ``most`` insertions, deletions and substitutions.

    Two such names have a common text among those that up to ``most`` deletions make of each (a substitution is a deletion on both sides), so joining these meets every
    pair; the distance itself decides. Equal names are one name. Texts travel as hashes; null names take no part, the empty name is one. Names that meet in many texts are one pair before they are measured.
    """
    once = names.select("name").where("name IS NOT NULL").distinct()
    spread = once.select("name", F.explode(F.transform(deletions(F.col("name"), most), lambda t: F.xxhash64(t))).alias("left"))
    met = spread.join(spread.select(F.col("name").alias("other"), "left"), "left").where("name < other").select("name", "other").distinct()
    return met.withColumn("distance", F.levenshtein("name", "other")).where(F.col("distance") <= most)
