"""Helpers that several corpus operators share: batch sizes, bucketed tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The operators here take the library's scratch tables and running sums from this module as well.
from graphweave.operators.scratch import discard, running_sum, shared_folder, shuffle_partitions, written  # noqa: F401

#: The white space that separates words in every contract here.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for this session: whole texts travel to Python in them, and a worker holds one or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside: rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As ``written``, in hash buckets of ``key``: joining or grouping by it later needs no shuffle of these rows.

    Only a catalog table can tell Spark of buckets; its entry goes again at once, the plan that has read it keeps them.
    """
    spark = df.sparkSession
    table = f"graphweave_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected graph with the least node of their component.

    ``edges`` has columns ``a`` and ``b`` (any one orderable type). Large-star and small-star rounds
    until no edge changes; every round is written to the shared folder. Returns ``node, component``
    for nodes that have an edge to another node.
    """
    bound = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    bound = written(bound, "edges")
    seen = None
    for _ in range(most_rounds):
        both = bound.union(bound.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, bound = bound, written(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(before)
        state = bound.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = bound.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(bound.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
