"""Bounded traversal of a property graph by frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.masks import cleared
from graphweave.operators.scratch import discard, release, written


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``root, kind, key, depth, conf``: nodes within ``depth`` steps of each root.

    A path's confidence is its least edge's. States are kept per (root, node, depth) with the best confidence
    at that depth, which is the Pareto frontier of confidence and length; one join and one partial
    aggregation a step. The edges and each front are written once. Cycles end at the depth bound, an empty front ends the walk.
    """
    steps = written(edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("key"), "dst_kind", "dst", F.col("conf").alias("step")), "edges")
    front = written(roots.select("root", "kind", "key", F.lit(0).alias("depth"), F.lit(100).alias("conf")), "front")
    out = front
    for d in range(1, depth + 1):
        moved = front.join(steps, ["kind", "key"]).select("root", F.col("dst_kind").alias("kind"), F.col("dst").alias("key"), F.least("conf", "step").alias("conf"))
        front = moved.groupBy("root", "kind", "key").agg(F.max("conf").alias("conf")).select("root", "kind", "key", F.lit(d).alias("depth"), "conf")
        front = written(front, "front")
        if d == depth or front.isEmpty():
            out = out.unionByName(front)
            break
        out = out.unionByName(front)
    discard(steps)
    return out


#: So many kinds of nodes at most are told apart when a round chooses what it reads; so many rows at most go to every task.
_MOST_KINDS, _FEW = 1000, 100_000


def _kinds(df: DataFrame, *columns: str) -> set[tuple] | None:
    """The distinct values of ``columns``, kinds of nodes; none if they are too many to choose by."""
    found = df.select(*columns).distinct().limit(_MOST_KINDS + 1).collect()
    return None if len(found) > _MOST_KINDS else {tuple(r) for r in found}


def _of_kinds(df: DataFrame, kinds: set | None) -> DataFrame:
    """Rows whose kind is among ``kinds``; all where these are not known."""
    if kinds is None:
        return df
    named = F.col("kind").isin(sorted(k for k in kinds if k is not None))
    return df.where(named | F.col("kind").isNull() if None in kinds else named)


def taint_walk(edges: DataFrame, sources: DataFrame, most_rounds: int = 1000, trace: bool = False, winners: bool = False) -> DataFrame:
    """``root, kind, key, mask, conf, depth``: what taint of each source arrives where, how surely and how near.

    ``edges`` has ``src_kind, src, dst_kind, dst, conf, clears``; ``sources`` has ``root, kind, key, mask``. Along an edge the taint loses the
    kinds in ``clears`` and the path's confidence is its least edge's. A state is kept unless one of no greater depth at the same node has all its
    kinds and at least its confidence, so cycles end by themselves: kinds and confidences only fall. States without taint go no further.
    The seen states are written round by round, and each round only the new ones move. A round is one join of the moving states and one grouping by
    node, in which a node's states meet as arrays; these hold only states of which none covers another. A round reads only the edges that leave the kinds of nodes it
    moves from, and only the seen states at kinds of nodes it can arrive at; where few states move, edges and seen states stay where they are and only those at the nodes of these meet.

    With ``trace`` every state has ``prev`` too, the state it came from (null at a source): a struct of ``doubt`` (confidence, negative), ``kind``, ``key`` and ``less``
    (mask, negative), of several possible ones the least. See ``rebuilt``.

    With ``winners`` states go too each of whose kinds some nearer state of the node carries at least as surely, not all kinds the same state: for no kind and no node can they lie on a path
    that is the surest, then the nearest. What is left holds all such paths, the least of equal ones among them.
    """
    steps = written(edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("key"), "dst_kind", "dst", F.col("conf").alias("step"), "clears"), "edges")
    # The keys come first as they tell most nodes apart, which sorts need.
    node, columns = ["key", "kind", "root"], ["root", "kind", "key", "mask", "conf", "depth", *(["prev"] if trace else [])]
    before = F.struct((-F.col("conf")).alias("doubt"), "kind", "key", (-F.col("mask")).alias("less"))
    front = sources.where("mask <> 0").groupBy(*node, F.col("mask").cast("int").alias("mask")).agg(F.lit(100).alias("conf")).withColumn("depth", F.lit(0))
    front = written(front.withColumn("prev", F.when(F.lit(False), before)).select(*columns), "front")
    links, kinds = _kinds(steps, "kind", "dst_kind"), _kinds(front, "kind")
    kinds = None if links is None or kinds is None else {k for (k,) in kinds}
    seen, moving = [(kinds, front)], front.count()
    for d in range(1, most_rounds + 1):
        ahead = None if kinds is None else {to for k, to in links if k in kinds and k is not None}
        few = moving <= _FEW
        moved = (F.broadcast(front) if few else front).join(_of_kinds(steps, kinds), ["key", "kind"])
        moved = moved.select("root", F.col("dst_kind").alias("kind"), F.col("dst").alias("key"), cleared(F.col("mask"), F.col("clears")).alias("mask"), F.least("conf", "step").alias("conf"), before.alias("prev"))
        best = moved.where("mask <> 0").groupBy(*node, "mask").agg(F.min(F.struct((-F.col("conf")).alias("doubt"), *(["prev"] if trace else []))).alias("b"))
        if few:
            best = written(best, "arrived")
            few = best.count() <= _FEW
            there_now = F.broadcast(best.select(*[F.col(c).alias(f"_{c}") for c in node]).distinct())
            at_once = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in node])
        new = F.struct("mask", (-F.col("b.doubt")).alias("conf"), *([F.col("b.prev").alias("prev")] if trace else []))
        arrived = best.select(*node, F.lit(None).cast("struct<mask:int,conf:int>").alias("old"), new.alias("new"))
        met = arrived
        for there, states in seen:
            if ahead is None or there & ahead:
                states = _of_kinds(states, ahead).select(*node, F.struct("mask", "conf").alias("old"), F.lit(None).cast(arrived.schema["new"].dataType).alias("new"))
                met = met.union(states.join(there_now, at_once, "left_semi") if few else states)
        met = met.groupBy(*node).agg(F.collect_list("old").alias("olds"), F.collect_list("new").alias("news")).where(F.size("news") > 0)
        covers = lambda o, n: (cleared(n["mask"], o["mask"]) == 0) & (o["conf"] >= n["conf"])
        # A state seen before covers an equal one; among the new ones only a truly better one does.
        truly = lambda o, n: covers(o, n) & ((o["mask"] != n["mask"]) | (o["conf"] != n["conf"]))
        surer = lambda n: F.aggregate("olds", F.lit(0), lambda kinds, o: F.when(o["conf"] >= n["conf"], kinds.bitwiseOR(o["mask"])).otherwise(kinds))
        known = (lambda n: cleared(n["mask"], surer(n)) == 0) if winners else (lambda n: F.exists("olds", lambda o: covers(o, n)))
        fresh = F.filter("news", lambda n: ~known(n) & ~F.exists("news", lambda o: truly(o, n)))
        front = written(met.select(*node, F.explode(fresh).alias("n")).select(*node, "n.*").withColumn("depth", F.lit(d)).select(*columns), "front")
        moving = front.count()
        release(front)
        if not moving:
            break
        kinds = ahead
        seen.append((kinds, front))
    else:
        raise RuntimeError(f"taint did not settle in {most_rounds} rounds")
    discard(steps)
    return reduce(DataFrame.unionByName, [states for _, states in seen])


def rebuilt(states: DataFrame, winners: DataFrame) -> DataFrame:
    """``winners`` (rows of a traced walk's ``states``, with any further columns) with ``steps``: the states from the source to the winner, in order, as structs of kind, key, mask and conf.

    Joins follow the pointers of the winners, from the deepest down: a pointer names a state one step nearer, which is unique by root, node, mask and confidence, so a round joins the winners of its
    depth and of greater ones with the states of one depth. Where the states near the sources are fewer than the winners, as what few roots branch into, their ways are built forward instead, once for all.
    """
    rest = [c for c in winners.columns if c != "prev"]
    here = lambda kind, key, mask, conf: F.array(F.struct(F.col(kind).alias("kind"), F.col(key).alias("key"), mask.alias("mask"), conf.alias("conf")))
    own = here("kind", "key", F.col("mask"), F.col("conf"))
    ends = written(winners.select(*rest, "prev", own.alias("steps")), "ways")
    level = lambda df, d: df.where(F.col("depth") == d)
    as_before = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])
    same = (F.col("prev.key") == F.col("_key")) & (F.col("prev.kind") == F.col("_kind")) & (F.col("root") == F.col("_root")) & (F.col("prev.less") == -F.col("_mask")) & (F.col("prev.doubt") == -F.col("_conf"))
    count = {d: n for d, n in states.groupBy("depth").count().collect()}
    deepest, many = ends.agg(F.max("depth"), F.count("*")).first()
    near, held = 0, count.get(0, 0)
    while near + 1 < (deepest or 0) and held + count.get(near + 1, 0) < many / 2:
        near, held = near + 1, held + count.get(near + 1, 0)
    # The ways to the states within ``near`` steps, by depth.
    trails = [level(states, 0).select("root", "kind", "key", "mask", "conf", own.alias("steps"))]
    for d in range(1, near + 1):
        further = level(states, d).join(as_before(trails[-1]), same).select("root", "kind", "key", "mask", "conf", F.concat("_steps", own).alias("steps"))
        trails.append(written(further, "trails"))
    done, way = [level(ends, 0).drop("prev")], None
    for d in range(deepest or 0, 0, -1):
        left, farther = level(ends, d), way
        left = left if way is None or d <= near else left.unionByName(way)
        if d <= near + 1:
            done.append(left.join(as_before(trails[d - 1]), same).select(*rest, F.concat("_steps", "steps").alias("steps")))
            continue
        back = as_before(level(states, d - 1).select("root", "kind", "key", "mask", "conf", "prev"))
        longer = F.concat(here("prev.kind", "prev.key", -F.col("prev.less"), -F.col("prev.doubt")), "steps")
        way = written(left.join(back, same).select(*rest, F.col("_prev").alias("prev"), longer.alias("steps")), "ways")
        if farther is not None:
            discard(farther)
        release(way)
    return reduce(DataFrame.unionByName, done)


def block_dataflow(flow: DataFrame, blocks: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Forward may-analysis over blocks: ``method, block, entering, leaving`` taint masks.

    ``flow`` has ``method, src, dst``; ``blocks`` has ``method, block, gen, kill``. What enters a block is the union (bit or) of what leaves the blocks before it;
    what leaves is that without ``kill``, with ``gen``. Bits only grow, so rounds end after at most as many as there are bits and blocks on a
    way; each round passes on only the bits that are new, and branches cost their edges, not their paths.
    """
    edges = written(flow.select("method", F.col("src").alias("block"), "dst"), "flow")
    state = written(blocks.select("method", "block", "kill", F.lit(0).alias("entering"), F.col("gen").alias("leaving"), F.col("gen").alias("fresh")), "blocks")
    for _ in range(most_rounds):
        arrived = state.where("fresh <> 0").join(edges, ["method", "block"]).groupBy("method", F.col("dst").alias("block")).agg(F.bit_or("fresh").alias("arrived"))
        joined = state.drop("fresh").join(arrived, ["method", "block"], "left")
        entering = F.col("entering").bitwiseOR(F.coalesce("arrived", F.lit(0)))
        passed = cleared(entering, F.col("kill"))
        now = joined.select("method", "block", "kill", entering.alias("entering"), F.col("leaving").bitwiseOR(passed).alias("leaving"), cleared(passed, F.col("leaving")).alias("fresh"))
        before, state = state, written(now, "blocks")
        discard(before)
        if state.where("fresh <> 0").isEmpty():
            break
    else:
        raise RuntimeError(f"masks did not settle in {most_rounds} rounds")
    discard(edges)
    return state.select("method", "block", "entering", "leaving")


def fold_tree(nodes: DataFrame) -> DataFrame:
    """Masks of expression trees from the leaves up: ``tree, node, mask``.

    ``nodes`` has ``tree, node, parent`` (null at the top) ``, depth`` (0 at the top) ``, own, clears``. A node's mask is the union of its own and its children's, less what it clears:
    operators and unknown calls pass everything on, sanitizers and casts clear what they declare. One join and one partial aggregation a level.
    """
    held = written(nodes.select("tree", "node", "parent", "depth", "own", "clears"), "nodes")
    deepest = held.agg(F.max("depth")).first()[0]
    out, below = [], None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = held.where(F.col("depth") == d)
        if below is not None:
            passed = below.groupBy("tree", F.col("parent").alias("node")).agg(F.bit_or("mask").alias("passed"))
            level = level.join(passed, ["tree", "node"], "left").withColumn("own", F.col("own").bitwiseOR(F.coalesce("passed", F.lit(0))))
        below = written(level.select("tree", "node", "parent", cleared(F.col("own"), F.col("clears")).alias("mask")), "level")
        out.append(below.select("tree", "node", "mask"))
    return reduce(DataFrame.unionByName, out) if out else held.select("tree", "node", F.col("own").alias("mask"))


def best_paths(reached: DataFrame) -> DataFrame:
    """Per root and node the surest path, the shortest of equals: ``root, kind, key, conf, depth``."""
    best = F.max(F.struct("conf", (-F.col("depth")).alias("near"))).alias("b")
    return reached.groupBy("root", "kind", "key").agg(best).select("root", "kind", "key", F.col("b.conf").alias("conf"), (-F.col("b.near")).alias("depth"))


def climb(parents: DataFrame, depth: int) -> DataFrame:
    """Chains upward in a table ``child, parent`` (null parent: a base; a parent without a row: it leaves the project).

    Returns ``child, top, steps, complete``: the last node in the project, the steps to it, and whether the chain
    ends in a base within ``depth`` steps (a cycle does not). Every step is one join with a written table; chains that have ended move no further, and when none is left the climb ends.
    """
    known = written(parents.select(F.col("child").alias("k"), F.col("parent").alias("up")), "parents")
    now = parents.select("child", F.col("child").alias("top"), F.col("parent").alias("next"), F.lit(0).alias("steps"))
    done = None
    for _ in range(depth):
        state = written(now.join(known, F.col("next") == F.col("k"), "left"), "chains")
        ended = state.where(F.col("k").isNull()).select("child", "top", "steps", F.col("next").isNull().alias("complete"))
        done = ended if done is None else done.unionByName(ended)
        now = state.where(F.col("k").isNotNull()).select("child", F.col("k").alias("top"), F.col("up").alias("next"), (F.col("steps") + 1).alias("steps"))
        if now.isEmpty():
            break
    discard(known)
    rest = now.select("child", "top", "steps", F.lit(False).alias("complete"))
    return rest if done is None else done.unionByName(rest)
