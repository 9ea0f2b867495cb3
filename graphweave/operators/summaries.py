"""What methods do with each of their parameters, composed over calls; taint that is stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.functions.masks import ALL
from graphweave.operators.scratch import discard, written
from graphweave.operators.traverse import taint_walk

#: Places of a symbol's own ports besides its parameters (0, 1, ..), and of a call's besides its arguments.
RETURN, SINK, RESULT = -1, -2, -1


def parameter_facts(flows: DataFrame, calls: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``symbol, param, site, pos, mask``: the kinds of taint in each parameter of a symbol that arrive at each port of its body, whoever calls it.

    A port is a ``site`` and a place ``pos``: with the empty site the symbol's own parameter (0, 1, ..), RETURN or SINK (the kinds that some sink
    in it or below it takes), with a call's site its argument (0, 1, ..) or RESULT. ``flows`` has ``symbol, src_site, src_pos, dst_site, dst_pos, keeps``: along such a step of the
    body the kinds in ``keeps`` remain. ``calls`` has ``symbol, site, callee``; a call may have several callees, and a null one is unknown and passes everything on to its result.

    A call applies what its callee is known to do with the parameter that the argument goes to, so taint of one caller never comes out at another. Facts
    only gain kinds, so this ends also where calls recur. A round joins new facts with flows and with summaries, and facts with new summaries.
    """
    kind = flows.schema["symbol"].dataType.simpleString()
    steps = written(flows.select("symbol", F.col("src_site").alias("site"), F.col("src_pos").alias("pos"), "dst_site", "dst_pos", "keeps").distinct(), "flows")
    sites = written(calls.select("symbol", "site", "callee").distinct(), "calls")
    port = ["symbol", "param", "site", "pos"]
    start = steps.where("site = '' AND pos >= 0").select("symbol", F.col("pos").alias("param"), "site", "pos").distinct()
    state = written(start.select(*port, F.lit(ALL).alias("mask"), F.lit(ALL).alias("fresh")), "facts")
    for _ in range(most_rounds):
        moved = state.where("fresh <> 0").join(steps, ["symbol", "site", "pos"]).select("symbol", "param", F.col("dst_site").alias("site"), F.col("dst_pos").alias("pos"), F.col("fresh").bitwiseAND(F.col("keeps")).alias("got"))
        asked = state.where("site <> '' AND pos >= 0").select(*port, "mask", "fresh").join(sites, ["symbol", "site"])
        passed = asked.where("callee IS NULL").select("symbol", "param", "site", F.lit(RESULT).alias("pos"), F.col("fresh").alias("got"))
        known = state.where(f"site = '' AND pos IN ({RETURN}, {SINK})").select(F.col("symbol").alias("callee"), F.col("param").alias("pos"), F.col("pos").alias("end"), F.col("mask").alias("all_of"), F.col("fresh").alias("new_of"))
        met = asked.join(known, ["callee", "pos"])
        got = F.col("fresh").bitwiseAND(F.col("all_of")).bitwiseOR(F.col("mask").bitwiseAND(F.col("new_of")))
        through = met.select("symbol", "param", F.when(F.col("end") == RETURN, F.col("site")).otherwise("").alias("site"), F.when(F.col("end") == RETURN, RESULT).otherwise(SINK).alias("pos"), got.alias("got"))
        arrived = moved.union(passed).union(through).where("got <> 0").groupBy(*port).agg(F.bit_or("got").alias("got"))
        held = F.coalesce("mask", F.lit(0))
        arrived_at = F.coalesce("got", F.lit(0))
        joined = state.drop("fresh").join(arrived, port, "full")
        now = joined.select(*port, held.bitwiseOR(arrived_at).alias("mask"), arrived_at.bitwiseAND(F.bitwise_not(held)).alias("fresh"))
        before, state = state, written(now.select(F.col("symbol").cast(kind).alias("symbol"), *port[1:], "mask", "fresh"), "facts")
        discard(before)
        if state.where("fresh <> 0").isEmpty():
            discard(steps, sites)
            return state.select(*port, "mask")
    raise RuntimeError(f"summaries did not settle in {most_rounds} rounds")


def summaries(facts: DataFrame) -> DataFrame:
    """``symbol, returns, sinks``: per symbol arrays by parameter of the kinds that come out at its return and of those that reach sinks, from ``parameter_facts``."""
    own = facts.where(f"site = '' AND (pos IN ({RETURN}, {SINK}) OR pos = param)").groupBy("symbol", "param").agg(
        F.bit_or(F.when(F.col("pos") == RETURN, F.col("mask")).otherwise(0)).alias("out"), F.bit_or(F.when(F.col("pos") == SINK, F.col("mask")).otherwise(0)).alias("sunk")
    )
    rows = own.groupBy("symbol").agg(F.max("param").alias("last"), F.map_from_entries(F.collect_list(F.struct("param", F.struct("out", "sunk")))).alias("by"))
    pick = lambda what: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("by", i)[what], F.lit(0)))
    return rows.select("symbol", pick("out").alias("returns"), pick("sunk").alias("sinks"))


def stored_taint(edges: DataFrame, sources: DataFrame, writes: DataFrame, reads: DataFrame, most_rounds: int = 100) -> DataFrame:
    """The states of ``taint_walk`` with ``generation``: 1 for what comes from ``sources``, n + 1 for what was written to a column by generation n and read again.

    ``writes`` has ``kind, key, column, keeps`` (the kinds that the column keeps), ``reads`` has ``column, kind, key``. A column with new kinds is a source of these
    at everything that reads it, under the root ``stored:column``. Columns only gain kinds, so this ends; a cycle of writes and reads adds nothing twice.
    """
    held = None
    out = None
    asked = sources
    for generation in range(1, most_rounds + 1):
        walked = taint_walk(edges, asked)
        found = walked.withColumn("generation", F.lit(generation))
        out = found if out is None else out.unionByName(found)
        stored = walked.groupBy("kind", "key").agg(F.bit_or("mask").alias("mask")).join(writes, ["kind", "key"])
        stored = stored.groupBy("column").agg(F.bit_or(F.col("mask").bitwiseAND(F.col("keeps"))).alias("got")).where("got <> 0")
        if held is None:
            now = written(stored.select("column", F.col("got").alias("mask"), F.col("got").alias("fresh")), "columns")
        else:
            mask, got = F.coalesce("mask", F.lit(0)), F.coalesce("got", F.lit(0))
            now = written(held.drop("fresh").join(stored, "column", "full").select("column", mask.bitwiseOR(got).alias("mask"), got.bitwiseAND(F.bitwise_not(mask)).alias("fresh")), "columns")
            discard(held)
        held = now
        fresh = held.where("fresh <> 0")
        if fresh.isEmpty():
            return out
        asked = fresh.join(reads.distinct(), "column").select(F.concat(F.lit("stored:"), "column").alias("root"), "kind", "key", F.col("fresh").alias("mask"))
    raise RuntimeError(f"stored taint did not settle in {most_rounds} generations")
