"""Sharding along a Hilbert curve over document metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import running_sum, written

BITS = 5


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``axes`` (n points, d coordinates under 2**bits).

    Skilling's transform (2004): undo the excess work from the top bit down, Gray-encode, then
    interleave the bits, the first coordinate's first. Needs d * bits <= 63.
    """
    x = axes.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            set_ = (x[:, i] & q) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(set_, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def shard(docs: DataFrame, shards: int = 40, bits: int = BITS, law: str = "rows") -> DataFrame:
    """Order documents along a Hilbert curve and cut the order into ``shards`` runs.

    Dimensions, each quantised to ``2**bits`` cells: language and source (by hash), UTF-8 size (by its
    logarithm's place between the least and the greatest), and doc_id (likewise). Shards are runs of the curve, so
    each file covers a small box in all four and minimum/maximum statistics prune. Law ``rows``: counts at most one
    apart; law ``bytes``: each run ends where the running size passes its equal share. Ties on the curve fall by text CRC, so
    equal texts lie together where their metadata agree, then doc_id.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Null text has no bytes (size
    16, CRC 0); null metadata take cell 0. Repeated rows get a slot each. No rows give no rows.
    Other columns are ignored.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col("lang").isNull(), 0).otherwise(F.pmod(F.xxhash64("lang"), F.lit(1 << bits))).alias("d_lang"),
        F.when(F.col("source").isNull(), 0).otherwise(F.pmod(F.xxhash64("source"), F.lit(1 << bits))).alias("d_source"),
    )
    slim = written(slim, "metadata")
    span = slim.agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"), F.min(F.log2("size")).alias("least_log"), F.max(F.log2("size")).alias("greatest_log"))
    scaled = (F.col("doc_id") - F.col("least_id")).cast("double") / (F.col("greatest_id") - F.col("least_id") + 1).cast("double")
    sized = F.try_divide(F.log2("size") - F.col("least_log"), F.col("greatest_log") - F.col("least_log"))
    cell = lambda share: F.least(F.floor(F.coalesce(share, F.lit(0.0)) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    placed = slim.crossJoin(F.broadcast(span)).withColumn("d_size", cell(sized)).withColumn("d_id", cell(scaled))

    @F.pandas_udf("long")
    def curve(lang: pd.Series, source: pd.Series, size: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([lang, source, size, number], axis=1), bits))

    placed = placed.select("doc_id", "size", "text_crc32", curve("d_lang", "d_source", "d_size", "d_id").alias("curve"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    placed = placed.withColumn("one", F.lit(1).cast("long"))
    run = running_sum(placed, order, "one", "place")
    if law == "bytes":
        run = running_sum(run, ["place"], "size", "passed")
    whole = slim.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    run = run.crossJoin(F.broadcast(whole))
    if law == "rows":
        # Shard s takes the places from ceil(s * n / shards) on: counts are at most one apart.
        number = F.expr(f"((place - 1) * {shards}) DIV n")
    else:
        number = F.least(F.expr(f"CAST(((passed - size / 2) * {shards}) / bytes AS BIGINT)"), F.lit(shards - 1))
    run = written(run.withColumn("shard", number.cast("int")).drop("curve", "one", "n", "bytes"), "shards")
    first = run.groupBy("shard").agg(F.min("place").alias("first"))
    out = run.join(F.broadcast(first), "shard")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return shard(docs)
