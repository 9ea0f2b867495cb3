"""Edges from facts of a project: flattened with what they leave unresolved, template data, gates of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.identity import node_id
from graphweave.functions.masks import mask
from graphweave.operators.traverse import taint_walk


def flatten(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``kind, src_id, dst_id, conf, missing``: every distinct edge with the ids of its ends, and which end is declared nowhere (``source``, ``target``, ``both``; null: it is resolved).

    ``edges`` has ``kind, src_kind, src, dst_kind, dst, conf`` (of equal edges the surest counts), ``nodes`` has ``kind, key``; keys are texts. An edge without a key at an end lacks that end.
    """
    known = nodes.select("kind", "key").where("key IS NOT NULL").distinct()
    once = edges.groupBy("kind", "src_kind", "src", "dst_kind", "dst").agg(F.max("conf").alias("conf"))
    found = once.join(known.toDF("src_kind", "src").withColumn("_src", F.lit(True)), ["src_kind", "src"], "left").join(known.toDF("dst_kind", "dst").withColumn("_dst", F.lit(True)), ["dst_kind", "dst"], "left")
    missing = F.when(F.col("_src").isNull() & F.col("_dst").isNull(), "both").when(F.col("_src").isNull(), "source").when(F.col("_dst").isNull(), "target")
    return found.select("kind", node_id(F.col("src_kind"), F.col("src")).alias("src_id"), node_id(F.col("dst_kind"), F.col("dst")).alias("dst_id"), "conf", missing.alias("missing"))


def uses_trait(types: DataFrame) -> DataFrame:
    """``type, trait``: one row per trait of each type's list ``traits``; nulls and repeats in it go."""
    return types.select("type", F.explode("traits").alias("trait")).where("trait IS NOT NULL").distinct()


def duck_calls(calls: DataFrame, methods: DataFrame, surest: int = 40) -> DataFrame:
    """``call, method, owner, conf``: calls of a ``method`` on an unknown receiver with every class that has one; ``surest`` hundredths are shared among them, rounded down.

    ``calls`` has ``call, method``, ``methods`` has ``owner, name``. A call that no class answers has no row.
    """
    has = methods.select(F.col("name").alias("method"), "owner").distinct()
    shares = has.groupBy("method").agg(F.count("*").alias("n"))
    rows = calls.select("call", "method").distinct().join(shares, "method").join(has, "method")
    return rows.select("call", "method", "owner", F.floor(F.lit(surest) / F.col("n")).cast("int").alias("conf"))


def variable(template: Column, name: Column) -> Column:
    """The node of a template's variable."""
    return F.concat_ws("$", template.cast("string"), name)


def template_echoes(data: DataFrame, loops: DataFrame, passes: DataFrame, echoes: DataFrame) -> DataFrame:
    """``root, template, variable, line, rule``: echoes that print what a view's data still taints, through loops, includes, layouts and components.

    ``data`` has ``root, template, variable, mask``: what a view binds. ``loops`` has ``template, collection, variable``: a loop variable holds what the collection does. ``passes`` has
    ``src, src_variable, dst, dst_variable, clears``: variables that a template hands on, under which name, less the kinds that are cleared on the way. ``echoes`` has
    ``template, variable, line, context``: ``raw`` prints without escaping (rule ``raw-echo``, kind html), ``script`` into a script (``js-echo``, kind js), others are safe. Templates that include each other end by themselves.
    """
    kind, sure = F.lit("variable"), F.lit(100)
    inner = loops.select(kind.alias("src_kind"), variable(F.col("template"), F.col("collection")).alias("src"), kind.alias("dst_kind"), variable(F.col("template"), F.col("variable")).alias("dst"), sure.alias("conf"), F.lit(0).alias("clears"))
    outer = passes.select(kind.alias("src_kind"), variable(F.col("src"), F.col("src_variable")).alias("src"), kind.alias("dst_kind"), variable(F.col("dst"), F.col("dst_variable")).alias("dst"), sure.alias("conf"), F.coalesce("clears", F.lit(0)).alias("clears"))
    sources = data.select("root", kind.alias("kind"), variable(F.col("template"), F.col("variable")).alias("key"), "mask")
    held = taint_walk(inner.unionByName(outer).distinct(), sources).groupBy("root", "key").agg(F.bit_or("mask").alias("mask"))
    bit = F.when(F.col("context") == "raw", mask("html")).when(F.col("context") == "script", mask("js"))
    sinks = echoes.select("template", "variable", "line", bit.alias("bit"), variable(F.col("template"), F.col("variable")).alias("key")).where("bit IS NOT NULL").distinct()
    hits = held.join(sinks, "key").where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return hits.select("root", "template", "variable", "line", F.when(F.col("bit") == mask("html"), "raw-echo").otherwise("js-echo").alias("rule"))


def gated(routes: DataFrame, handlers: DataFrame) -> DataFrame:
    """``route, gated``: whether any middleware of a route turns requests away: one that is unresolved (``?``), an ability (``can:``), or a class whose handler aborts with 403 or redirects.

    ``routes`` has ``route, middleware`` (names, with arguments after a colon), ``handlers`` has ``class, call, argument``, the calls in each middleware's handler and their first argument. Routes without middleware are open.
    """
    turns = ((F.col("call") == "abort") & (F.trim("argument") == "403")) | F.col("call").isin("redirect", "redirectTo")
    gates = handlers.where(turns).select(F.col("class").alias("name"), F.lit(True).alias("gate")).distinct()
    names = routes.select("route", F.explode_outer("middleware").alias("full")).withColumn("name", F.substring_index("full", ":", 1))
    closes = (F.col("full") == "?") | F.col("full").startswith("can:") | F.coalesce("gate", F.lit(False))
    return names.join(gates, "name", "left").groupBy("route").agg(F.bool_or(F.coalesce(closes, F.lit(False))).alias("gated"))
