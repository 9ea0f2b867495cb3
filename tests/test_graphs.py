"""Strong components, levels, dominators, dead code, surest paths and traced taint against brute force on random graphs."""

import itertools
import random

import pytest

from graphweave.functions.masks import ALL
from graphweave.operators import graphs
from graphweave.operators.traverse import rebuilt, taint_walk

EDGES = "src long, dst long, conf int, label string"


def random_graphs(seed, count, nodes, edges):
    """Disjoint random graphs in one, with loops and repeated edges: edges (src, dst, conf) and the nodes 100 i of each graph as roots."""
    rng = random.Random(seed)
    out = []
    for g in range(count):
        base = 100 * g
        for _ in range(rng.randint(edges // 2, edges)):
            out.append((base + rng.randrange(nodes), base + rng.randrange(nodes), rng.randint(1, 9) * 10, "x"))
    return [*out, out[0]], [100 * g for g in range(count)]


def closure(edges, without=None):
    after = {}
    for s, d, *_ in edges:
        if without not in (s, d):
            after.setdefault(s, set()).add(d)

    def from_(n):
        seen, todo = {n}, [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    return from_


@pytest.fixture(scope="module")
def graph(spark):
    edges, roots = random_graphs(1, 12, 12, 26)
    return edges, roots, spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in [*roots, roots[0], 9999]], "node long")


def test_strong_components_and_levels(spark, graph):
    edges, _, df, _ = graph
    nodes = {n for e in edges for n in e[:2]}
    ways = closure(edges)
    reach = {n: ways(n) for n in nodes}
    want = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    got = graphs.strong_components(df)
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(nodes)
    dag = graphs.condensed(df, got)
    links = {(want[s], want[d]) for s, d, *_ in edges if want[s] != want[d]}
    assert {tuple(r) for r in dag.collect()} == links
    level = {r["node"]: r["level"] for r in graphs.levels(dag, got.select(got["component"].alias("node"))).collect()}
    assert set(level) == set(want.values())
    for n, v in level.items():
        assert v == max((level[s] + 1 for s, d in links if d == n), default=0)
    with pytest.raises(ValueError):
        graphs.levels(df, df.selectExpr("src AS node"))


def test_dominators_and_dead_nodes(spark, graph):
    edges, roots, df, top = graph
    live = set().union(*(closure(edges)(r) for r in roots)) | {9999}
    got = {r["node"]: r["dominators"] for r in graphs.dominators(df, top).collect()}
    assert set(got) == live
    for d in live:
        ways = closure(edges, without=d)
        left = set().union(*(ways(r) for r in [*roots, 9999] if r != d))
        assert {n for n in live if d in got[n]} == live - left
    depth = {r["node"]: r["depth"] for r in graphs.reached(df, top).collect()}
    assert set(depth) == live and all(depth[r] == 0 for r in roots)


def simple_paths(edges, roots):
    best = {}
    for s, d, c, *_ in edges:
        if s != d:
            best[s, d] = max(c, best.get((s, d), 0))
    after = {}
    for (s, d), c in best.items():
        after.setdefault(s, []).append((d, c))
    todo = [((r,), 100) for r in roots]
    while todo:
        path, conf = todo.pop()
        yield path, conf
        todo.extend(((*path, d), min(conf, c)) for d, c in after.get(path[-1], ()) if d not in path)


@pytest.mark.parametrize("k", [1, 3])
def test_surest_paths_equal_enumeration(spark, k):
    edges, roots = random_graphs(2, 10, 7, 20)
    roots.append(101)
    ways = {}
    for path, conf in simple_paths(edges, roots):
        ways.setdefault(path[-1], []).append((-conf, len(path) - 1, " > ".join(map(str, path))))
    want = {(n, i, -c, length, text) for n, found in ways.items() for i, (c, length, text) in enumerate(sorted(found)[:k], 1)}
    got = graphs.surest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in roots], "node long"), k)
    assert {tuple(r) for r in got.collect()} == want


def test_shapes_of_nothing(spark):
    none, no_nodes = spark.createDataFrame([], EDGES), spark.createDataFrame([], "node long")
    assert graphs.strong_components(none).count() == 0 and graphs.dominators(none, no_nodes).count() == 0 and graphs.surest_paths(none, no_nodes, 3).count() == 0
    assert graphs.levels(none, no_nodes).count() == 0 and graphs.reached(none, no_nodes).count() == 0
    alone = spark.createDataFrame([(7,)], "node long")
    assert [tuple(r) for r in graphs.surest_paths(none, alone, 3).collect()] == [(7, 1, 100, 0, "7")]
    loop = spark.createDataFrame([(1, 1, 50, "x")], EDGES)
    assert [tuple(r) for r in graphs.strong_components(loop).collect()] == [(1, 1)]


def test_traced_walk_gives_the_least_best_path(spark):
    """Cyclic graphs: the path of each best state is the least of all walks by confidence, then from its end backward."""
    rng = random.Random(5)
    edges, roots = [], []
    for g in range(8):
        base = 100 * g
        roots.append((f"r{g}", "m", base, ALL if g % 2 else 7))
        edges += [("m", base + rng.randrange(6), "m", base + rng.randrange(6), rng.randint(5, 9) * 10, rng.choice([0, 0, 1, 2, 4])) for _ in range(12)]
    df = spark.createDataFrame(edges, "src_kind string, src long, dst_kind string, dst long, conf int, clears int")
    states = taint_walk(df, spark.createDataFrame(roots, "root string, kind string, key long, mask int"), trace=True)
    plain = {tuple(r) for r in states.drop("prev").collect()}
    got = {(r["root"], r["key"], r["mask"], r["conf"], r["depth"]): [(s["key"], s["mask"], s["conf"]) for s in r["steps"]] for r in rebuilt(states, states).collect()}
    assert {k[:2] + k[2:] for k in got} == {(root, key, mask, conf, depth) for root, _, key, mask, conf, depth in plain}
    walks = [((root, key, mask, 100),) for root, _, key, mask in roots]
    every = {}
    for _ in range(9):
        longer = []
        for w in walks:
            root, key, mask, conf = w[-1]
            every.setdefault((root, key, mask, conf, len(w) - 1), []).append(w)
            longer += [(*w, (root, d, mask & ~clears, min(conf, c))) for _, s, _, d, c, clears in edges if s == key and mask & ~clears]
        # The least walk to a state is all that can be the beginning of a least one.
        walks = [min(ws, key=lambda w: [(-c, k, -m) for _, k, m, c in reversed(w)]) for _, ws in itertools.groupby(sorted(set(longer), key=lambda w: w[-1]), key=lambda w: w[-1])]
    for state, steps in got.items():
        assert state[4] <= 8
        least = min(every[state], key=lambda w: [(-c, k, -m) for _, k, m, c in reversed(w)])
        assert steps == [(k, m, c) for _, k, m, c in least]
    # Every best state by brute force is there, or one that covers it.
    for root, key, mask, conf, depth in every:
        assert any(r == root and k == key and not mask & ~m and c >= conf and d <= depth for r, k, m, c, d in got)


def test_a_walk_for_winners_gives_the_best_path_of_every_kind(spark):
    """Cyclic graphs with several kinds of nodes: the path that the walk gives for each kind of taint is the best of all walks; states that cannot lie on one are not kept."""
    rng = random.Random(11)
    edges, roots = [], []
    for g in range(8):
        name = lambda i, g=g: ("mnf"[i % 3], 100 * g + i)
        roots += [(f"r{g % 5}", *name(0), ALL), (f"r{g % 5}", *name(3), 7)]
        edges += [(*name(rng.randrange(7)), *name(rng.randrange(7)), rng.randint(5, 9) * 10, rng.choice([0, 1, 2, 4, ALL & ~8])) for _ in range(16)]
    # A state at the end of the way 900, 903, 904 carries two kinds, of which each arrives sooner by a way of its own.
    roots.append(("r9", "m", 900, 3))
    edges += [("m", 900, "m", 901, 90, 1), ("m", 900, "m", 901, 90, 2), ("m", 900, "n", 903, 90, 0), ("n", 903, "m", 901, 90, 0), ("m", 901, "f", 902, 90, 0)]
    df = spark.createDataFrame(edges, "src_kind string, src long, dst_kind string, dst long, conf int, clears int")
    sources = spark.createDataFrame(roots, "root string, kind string, key long, mask int")
    states = taint_walk(df, sources, trace=True, winners=True)
    kept = {tuple(r) for r in states.drop("prev").collect()}
    assert kept < {tuple(r) for r in taint_walk(df, sources, trace=True).drop("prev").collect()}
    assert {r[3:] for r in kept if r[2] == 901} == {(1, 90, 1), (2, 90, 1)}
    got = {}
    for r in rebuilt(states, states).collect():
        way = [(-s["conf"], s["kind"], s["key"], -s["mask"]) for s in reversed(r["steps"])]
        assert len(way) == r["depth"] + 1 and way[0] == (-r["conf"], r["kind"], r["key"], -r["mask"])
        for bit in range(12):
            if r["mask"] >> bit & 1:
                got.setdefault((r["root"], r["key"], bit), []).append((-r["conf"], r["depth"], way))
    every, walks = {}, {(root, kind, key, mask, 100): [(-100, kind, key, -mask)] for root, kind, key, mask in roots}
    for depth in range(9):
        longer = {}
        for (root, kind, key, mask, conf), way in walks.items():
            for bit in range(12):
                if mask >> bit & 1:
                    every.setdefault((root, key, bit), []).append((-conf, depth, way))
            for sk, s, dk, d, c, clears in edges:
                if (sk, s) == (kind, key) and mask & ~clears:
                    to = (root, dk, d, mask & ~clears, min(conf, c))
                    on = [(-to[4], dk, d, -to[3]), *way]
                    longer[to] = min(longer.get(to, on), on)
        walks = longer
    assert {k: min(v) for k, v in got.items()} == {k: min(v) for k, v in every.items()}
