"""Runtime correlation: a stream of events meets the routes of the code graph, window by window, and is scored against a baseline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.patterns import safe_rate
from graphweave.operators.scratch import shared_folder


def windowed(events: DataFrame, routes: DataFrame, key: str, by: list[str], window: str, delay: str) -> DataFrame:
    """Counts per window of ``events`` (a stream with ``ts`` and ``key``) joined with the static ``routes`` by ``key``: ``start``, the columns ``by``, ``seen``, ``total``.

    Events without a route keep nulls. Rows of windows that closed ``delay`` before the newest row known when the batch before began are dropped (Spark's watermark for late rows); state of closed windows is let go.
    """
    joined = events.withWatermark("ts", delay).join(routes, key, "left")
    counted = joined.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("seen"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), *by, "seen", "total")


def drained(counts: DataFrame, keys: list[str], name: str = "runtime") -> DataFrame:
    """Run the stream on all that is there now and return the newest row of each of ``keys``, as a static table.

    Every batch writes the windows it has changed under its number, so a batch that runs again after a failure replaces what it wrote. Checkpoint and batches lie in the shared folder.
    """
    spark = counts.sparkSession
    folder = f"{shared_folder(spark)}/graphweave-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = counts.schema.add("batch", "long")
    # A stream without any file has run no batch.
    written = spark.read.schema(schema).parquet(f"{folder}/batches") if query.lastProgress else spark.createDataFrame([], schema)
    rest = [c for c in counts.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *[f"r.{c}" for c in rest])


def anomalies(counts: DataFrame, by: list[str], until) -> DataFrame:
    """Windows from ``until`` on with how many deviations ``seen`` lies from the mean of the route's windows before (``score``, to six places; null where those are fewer than two or all alike), and ``share``, its part of all of the window."""
    base = counts.where(F.col("start") < until).groupBy(*by).agg(F.count("*").alias("windows"), F.avg("seen").alias("mean"), F.stddev_pop("seen").alias("deviation"))
    base = base.select(*[F.col(c).alias(f"_{c}") for c in by], "windows", "mean", "deviation")
    new = counts.where(F.col("start") >= until)
    whole = new.groupBy("start").agg(F.sum("seen").alias("of"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    score = F.when((F.col("windows") > 1) & (F.col("deviation") > 0), F.round((F.col("seen") - F.col("mean")) / F.col("deviation"), 6))
    joined = new.join(whole, "start").join(base, same, "left")
    return joined.select("start", *by, "seen", "total", score.alias("score"), safe_rate(F.col("seen"), F.col("of")).alias("share"))


def event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The events in ``path``, a folder or one file, as a stream of files. (A stream takes a plain path for a folder; a pattern may name a file.)"""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")
