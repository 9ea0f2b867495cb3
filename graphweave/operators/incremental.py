"""Scans that work out again only what changed since the version stored before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.graphs import reached
from graphweave.operators.scratch import written
from graphweave.operators.store import Store
from graphweave.operators.traverse import block_dataflow


def changed_symbols(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """``node, change`` (added, removed, changed) by the ``digest`` of each ``node`` in two versions."""
    old = now.where("false") if before is None else before
    both = old.select("node", F.col("digest").alias("was"), F.lit(True).alias("old")).join(now.select("node", "digest", F.lit(True).alias("new")), "node", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("digest")), "changed")
    return both.select("node", change.alias("change")).where("change IS NOT NULL")


def _masks(edges: DataFrame, own: DataFrame) -> DataFrame:
    """``node, mask``: the kinds of everything that each node of ``own`` (``node, mask``) reaches along ``edges`` (``src, dst``), itself included."""
    flow = edges.select(F.lit(0).alias("method"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    blocks = own.select(F.lit(0).alias("method"), F.col("node").alias("block"), F.col("mask").alias("gen"), F.lit(0).alias("kill"))
    return block_dataflow(flow, blocks).select(F.col("block").alias("node"), F.col("leaving").alias("mask"))


def scan(store: Store, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Store a version of the graph with what each symbol reaches (``node, mask, touched``), recomputed only where the version before does not hold.

    ``symbols`` has ``node, digest, mask`` (a symbol's own kinds; a digest covers its body, that is its kinds and the edges out of it), ``edges`` has ``src, dst``. Symbols that were
    added or changed, and all that reach them, are touched; a removed one was called by symbols that changed. Only edges out of touched symbols are walked, and where
    such an edge leaves the touched part the stored mask of the other end stands for all behind it. The result and the digests are one commit.
    """
    before, held = store.read("symbols"), store.read("reach")
    symbols = written(symbols.select("node", "digest", "mask").distinct(), "symbols")
    changed = changed_symbols(before, symbols).where("change <> 'removed'").select("node")
    touched = written(reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed).select("node"), "touched")
    own = symbols.join(touched, "node", "left_semi").select("node", "mask")
    out_of = written(edges.select("src", "dst").distinct().join(touched.withColumnRenamed("node", "src"), "src", "left_semi"), "out_of")
    if held is None:
        found = _masks(out_of, own)
        result = found.withColumn("touched", F.lit(True))
    else:
        rest = held.select("node", F.col("mask").alias("stored")).join(touched, "node", "left_anti").join(symbols.select("node"), "node", "left_semi")
        edge_of = out_of.join(rest.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or("stored").alias("beyond"))
        start = own.join(edge_of, "node", "left").select("node", F.col("mask").bitwiseOR(F.coalesce("beyond", F.lit(0))).alias("mask"))
        inner = out_of.join(touched.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        result = _masks(inner, start).withColumn("touched", F.lit(True)).unionByName(rest.select("node", F.col("stored").alias("mask"), F.lit(False).alias("touched")))
    store.commit(symbols=symbols, reach=result)
    return store.read("reach")
