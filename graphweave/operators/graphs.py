"""Shape of a directed graph: strong components and their levels, dominators, what no root reaches, the k surest simple paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.scratch import discard, written


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _spread(edges: DataFrame, start: DataFrame, better: Callable, name: str, most_rounds: int) -> DataFrame:
    """The least (by ``better``) label that reaches each node of ``start`` (``node, label``) along ``edges``, to a fixpoint; only changed labels move."""
    state = written(start.withColumn("fresh", F.lit(True)), name)
    for _ in range(most_rounds):
        arrived = state.where("fresh").join(edges, state["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(better("label").alias("arrived"))
        now = F.when(F.col("arrived").isNull(), F.col("label")).otherwise(F.greatest("label", "arrived") if better is F.max else F.least("label", "arrived"))
        before, state = state, written(state.drop("fresh").join(arrived, "node", "left").select("node", now.alias("label"), (now != F.col("label")).alias("fresh")), name)
        discard(before)
        if state.where("fresh").isEmpty():
            return state.select("node", "label")
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``node, component`` (the greatest node of its strong component) of every node of ``edges`` (``src, dst``, ids that order).

    Trimming: a node without an edge in or out among those left is a component of its own; that repeats until none is left. Colouring: the greatest
    node that reaches each node is its colour; the nodes of a colour that reach back to it within the colour are its component.
    What is left after that begins anew. Every round is a written table and passes on only changed labels.
    """
    left = written(edges.select("src", "dst").where("src != dst").distinct(), "left")
    nodes = written(_nodes(edges), "nodes")
    done = []
    for _ in range(most_rounds):
        # Nodes without an edge both ways stand alone; only edges between the others go on.
        for _ in range(most_rounds):
            both = left.select(F.col("src").alias("node")).distinct().intersect(left.select(F.col("dst").alias("node")).distinct())
            inner = left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
            before, left = left, written(inner, "left")
            same = before.count() == left.count()
            discard(before)
            if same:
                break
        if left.isEmpty():
            break
        colour = _spread(left, _nodes(left).withColumn("label", F.col("node")), F.max, "colour", most_rounds)
        within = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "a")
        within = written(within, "within")
        # Backward from each colour's own node, within the colour.
        front = written(colour.where("node = label").select("node", F.col("label").alias("component")), "roots")
        found = front
        for _ in range(most_rounds):
            moved = front.join(within, (front["node"] == within["dst"]) & (front["component"] == within["a"])).select(F.col("src").alias("node"), "component").distinct()
            front = written(moved.join(found, ["node"], "left_anti"), "roots")
            if front.isEmpty():
                break
            found = found.union(front)
        found = written(found, "component")
        done.append(found)
        gone = found.select("node")
        before, left = left, written(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"), "left")
        discard(before, within)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    all_found = done[0]
    for f in done[1:]:
        all_found = all_found.union(f)
    return nodes.join(all_found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``src, dst``: the distinct edges between different strong components."""
    of = components.select("node", "component")
    e = edges.join(of.toDF("src", "s"), "src").join(of.toDF("dst", "d"), "dst").where("s != d")
    return e.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def levels(dag: DataFrame, nodes: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``node, level``: the longest way to each of ``nodes`` in a graph without cycles, 0 where nothing leads to it. A round settles a level, and its edges go; a cycle is an error."""
    left = written(dag.select("src", "dst").distinct(), "dag")
    rest = written(nodes.select("node").distinct(), "rest")
    out = None
    for level in range(most_rounds):
        ready = written(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "ready")
        if ready.isEmpty():
            if not rest.isEmpty():
                raise ValueError("levels need a graph without cycles")
            break
        placed = ready.withColumn("level", F.lit(level))
        out = placed if out is None else out.union(placed)
        old = left, rest
        left, rest = written(left.join(ready.toDF("src"), "src", "left_anti"), "dag"), written(rest.join(ready, "node", "left_anti"), "rest")
        discard(*old)
    else:
        raise RuntimeError(f"more than {most_rounds} levels")
    return out if out is not None else rest.withColumn("level", F.lit(0))


def reached(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``node, depth``: what ``roots`` (``node``) reach, and in how few steps."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    front = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    seen = front
    for d in range(1, most_rounds + 1):
        moved = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(moved.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            discard(steps)
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"more than {most_rounds} steps deep")


def dominators(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``node, dominators`` of every node that ``roots`` reach: the sorted nodes that all ways from any root to it pass, itself included.

    The roots hang from a node above all that is in no set. A set begins unknown and becomes what the known sets of its predecessors share, and the
    node itself; a node is looked at again when a predecessor's set has changed. Sets only shrink, so this ends; on a graph
    without cycles each settles at its longest way. What no root reaches is dead and has no row.
    """
    depth = written(reached(edges, roots, most_rounds), "depth")
    live = edges.select("src", "dst").distinct().join(depth.select(F.col("node").alias("src")), "src", "left_semi")
    top = roots.select("node").distinct()
    # Every root has the node above among its predecessors, so that nothing but the root itself dominates it.
    live = written(live.join(top.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "live")
    state = top.select("node", F.array("node").alias("set"), F.lit(True).alias("fresh"))
    others = depth.select("node").join(top, "node", "left_anti").select("node", F.lit(None).cast(state.schema["set"].dataType).alias("set"), F.lit(False).alias("fresh"))
    state = written(state.union(others), "sets")
    for _ in range(most_rounds):
        again = state.where("fresh").join(live, state["node"] == live["src"]).select("dst").distinct()
        known = live.join(again, "dst", "left_semi").join(state.where("set IS NOT NULL").select(F.col("node").alias("src"), "set"), "src")
        counts = known.groupBy("dst").agg(F.count("*").alias("of"))
        shared = known.select("dst", F.explode("set").alias("d")).groupBy("dst", "d").agg(F.count("*").alias("n")).join(counts, "dst").where("n = of")
        shared = shared.groupBy("dst").agg(F.collect_list("d").alias("shared"))
        met = again.join(shared, "dst", "left").select(F.col("dst").alias("node"), F.array_sort(F.array_union(F.coalesce("shared", F.array().cast(state.schema["set"].dataType)), F.array("dst"))).alias("met"))
        now = F.coalesce("met", "set")
        joined = state.drop("fresh").join(met, "node", "left")
        before, state = state, written(joined.select("node", now.alias("set"), (F.col("met").isNotNull() & ~F.col("met").eqNullSafe(F.col("set"))).alias("fresh")), "sets")
        discard(before)
        if state.where("fresh").isEmpty():
            discard(live, depth)
            return state.select("node", F.col("set").alias("dominators"))
    raise RuntimeError(f"dominators did not settle in {most_rounds} rounds")


def surest_paths(edges: DataFrame, roots: DataFrame, k: int, most_rounds: int = 1000) -> DataFrame:
    """``node, rank, conf, length, path``: of each node the ``k`` surest simple paths from any root, then the shortest, then the least as text (nodes joined by `` > ``).

    ``edges`` has ``src, dst, conf``, where the surest of several counts; a path's confidence is its least edge's, 100 for a root alone. Paths grow a step a round. A path to a node goes no
    further if ``k`` others to it dominate it: no less sure, and shorter or as long and of lesser text, and passing no node of the node's strong component that it
    does not pass as well. Whatever continues it continues these, too (a node passed before can only come again if it is in the same component), so none of the
    best is lost; on a graph without cycles a node keeps k paths a pair of confidence and length at most.
    """
    held = written(edges.where("src != dst").groupBy("src", "dst").agg(F.max("conf").cast("int").alias("step")), "edges")
    component = written(strong_components(held, most_rounds), "strong")
    steps = held.join(component.toDF("src", "from"), "src").join(component.toDF("dst", "to"), "dst")
    steps = written(steps.select("src", "dst", "step", (F.col("from") == F.col("to")).alias("inside")), "steps")
    front = roots.select("node").distinct().select("node", F.lit(100).alias("conf"), F.lit(0).alias("length"), F.col("node").cast("string").alias("path"), F.array("node").alias("inner"))
    front = written(front, "front")
    label = ["conf", "length", "path", "inner"]
    seen = front
    for d in range(1, most_rounds + 1):
        moved = front.join(steps, front["node"] == steps["src"]).where(~F.array_contains("inner", F.col("dst")))
        moved = moved.select(F.col("dst").alias("node"), F.least("conf", "step").alias("conf"), F.lit(d).alias("length"), F.concat_ws(" > ", "path", F.col("dst").cast("string")).alias("path"),
                             F.when(F.col("inside"), F.array_append("inner", F.col("dst"))).otherwise(F.array("dst")).alias("inner"))
        rows = seen.select("node", F.struct(*label, F.lit(False).alias("new")).alias("l")).union(moved.select("node", F.struct(*label, F.lit(True).alias("new")).alias("l")))
        groups = rows.groupBy("node").agg(F.collect_list("l").alias("ls")).where(F.exists("ls", lambda x: x["new"]))
        ahead = lambda m, x: (m["conf"] >= x["conf"]) & ((m["length"] < x["length"]) | (m["length"] == x["length"]) & (m["path"] < x["path"])) & (F.size(F.array_except(m["inner"], x["inner"])) == 0)
        kept = F.filter("ls", lambda x: x["new"] & (F.size(F.filter("ls", lambda m: ahead(m, x))) < k))
        front = written(groups.select("node", F.explode(kept).alias("l")).select("node", *[f"l.{c}" for c in label]), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError(f"paths did not end in {most_rounds} steps")
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("doubt"), "length", "path")))
    best = seen.groupBy("node").agg(F.slice(order, 1, k).alias("best")).select("node", F.posexplode("best").alias("at", "b"))
    return best.select("node", (F.col("at") + 1).alias("rank"), (-F.col("b.doubt")).alias("conf"), "b.length", "b.path")
