"""Choices among rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column], most: int = 1, number: str = "rn") -> DataFrame:
    """The first ``most`` rows of each group in a total order, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).where(F.col(number) <= most)


def innermost(points: DataFrame, spans: DataFrame, file: str, line: str, block: int = 64) -> DataFrame:
    """Narrowest span (``span_id, start, stop``) of the point's file that covers its line, ties to the least id; null if none.

    The join is on the file and the block of ``block`` lines, in which a span lies once for every block that it touches, so one long
    file is spread over its blocks; the range is the residual.
    """
    s = spans.select(F.col(file).alias("_file"), "span_id", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("stop") / block))).alias("_at"))
    hit = points.join(s, (points[file] == s["_file"]) & (F.floor(points[line] / block) == s["_at"]) & points[line].between(s["start"], s["stop"]), "left")
    best = F.min(F.struct((F.col("stop") - F.col("start")).alias("width"), "span_id")).alias("b")
    return hit.groupBy(*points.columns).agg(best).select(*points.columns, F.col("b.span_id").alias("span_id"), F.col("b.width").alias("width"))
