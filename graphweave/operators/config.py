"""Nested configuration: flattened to dotted keys, merged layer over layer, with environment values and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.operators.scratch import discard, written


def flattened(configs: DataFrame, most_depth: int = 64) -> DataFrame:
    """All columns of ``configs`` but ``config`` (a JSON object as text) with ``path`` (keys joined by dots) and ``value`` (text; null for null) of every leaf.

    Lists are leaves, as JSON; an empty object is none. A round opens one level; objects nested deeper than ``most_depth`` are an error. What is no object has no leaves. A text that is itself
    a JSON object counts as one.
    """
    keep = [c for c in configs.columns if c != "config"]
    level = written(configs.select(*keep, F.lit("").alias("path"), F.col("config").alias("value")).where("value IS NOT NULL"), "config")
    out = None
    for _ in range(most_depth):
        opened = level.select(*keep, "path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
        rows = written(opened.select(*keep, F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")).alias("path"), "value"), "config")
        discard(level)
        nested = F.coalesce(F.trim("value").startswith("{"), F.lit(False))
        leaves, level = rows.where(~nested), rows.where(nested)
        out = leaves if out is None else out.unionByName(leaves)
        if level.isEmpty():
            return out
        level = written(level, "config")
    raise RuntimeError(f"configuration nested deeper than {most_depth}")


def environment(flat: DataFrame, env: DataFrame) -> DataFrame:
    """``flat`` with ``value`` taken from the environment where ``env_name`` names it, else ``value`` (the default). ``env`` has ``name, text``; its last-sorted text counts; ``true``, ``false`` and ``null`` in any case are these values."""
    held = env.groupBy(F.col("name").alias("env_name")).agg(F.max("text").alias("_text"), F.lit(True).alias("_set"))
    low = F.lower("_text")
    said = F.when(low.isin("null", "(null)"), None).when(low.isin("true", "false"), low).otherwise(F.col("_text"))
    joined = flat.join(held, "env_name", "left")
    return joined.withColumn("value", F.when(F.col("_set"), said).otherwise(F.col("value"))).select(*flat.columns)


def _prefixes(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def deep_merged(flat: DataFrame, scope: list[str], rank: list[str]) -> DataFrame:
    """``scope``, ``path, value``: what is left of ``flat`` (with ``path, value``) when each row is laid over those of lesser ``rank`` in its scope, key by key.

    A leaf goes if a later one stands at its path, above it (a value took the place of the object it was in) or below it (an object took its place). Rows of one rank and path count once, the greatest value; null is a value.
    Each row meets only its own prefixes.
    """
    r = F.struct(*rank)
    rows = flat.groupBy(*scope, "path").agg(F.max(F.struct(*rank, F.col("value").isNotNull(), "value")).alias("m"))
    rows = rows.select(*scope, "path", F.struct(*[F.col(f"m.{c}").alias(c) for c in rank]).alias("rank"), F.col("m.value").alias("value"))
    spread = flat.select(*scope, r.alias("rank"), F.explode(_prefixes(F.col("path"))).alias("path"))
    latest = spread.groupBy(*scope, "path").agg(F.max("rank").alias("latest"))
    kept = rows.join(latest, [*scope, "path"]).where("rank = latest")
    above = kept.select(*scope, F.col("path").alias("leaf"), F.col("rank").alias("own"), F.explode(_prefixes(F.col("path"))).alias("path")).where("path != leaf")
    gone = above.join(rows.select(*scope, "path", "rank"), [*scope, "path"]).where("rank > own").select(*scope, F.col("leaf").alias("path")).distinct()
    return kept.join(gone, [*scope, "path"], "left_anti").select(*scope, "path", "value")
