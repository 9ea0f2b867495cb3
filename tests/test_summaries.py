"""Parameter-wise summaries and stored taint against brute force."""

import random

from graphweave.functions.masks import ALL, mask
from graphweave.operators.summaries import RESULT, RETURN, SINK, parameter_facts, stored_taint, summaries
from graphweave.operators.traverse import taint_walk

FLOWS = "symbol string, src_site string, src_pos int, dst_site string, dst_pos int, keeps int"
CALLS = "symbol string, site string, callee string"


def brute(flows, calls):
    """Facts by going round until nothing changes."""
    facts = {(s, p, "", p): ALL for s, site, p, *_ in flows if site == "" and p >= 0}
    while True:
        new = dict(facts)

        def add(key, m):
            if m:
                new[key] = new.get(key, 0) | m

        for (s, i, site, pos), m in facts.items():
            for s2, a, b, c, d, keeps in flows:
                if (s2, a, b) == (s, site, pos):
                    add((s, i, c, d), m & keeps)
            if site and pos >= 0:
                for s2, site2, callee in calls:
                    if (s2, site2) == (s, site):
                        if callee is None:
                            add((s, i, site, RESULT), m)
                        else:
                            add((s, i, site, RESULT), m & facts.get((callee, pos, "", RETURN), 0))
                            add((s, i, "", SINK), m & facts.get((callee, pos, "", SINK), 0))
        if new == facts:
            return facts
        facts = new


def test_summaries_equal_brute_force(spark):
    rng = random.Random(3)
    flows, calls = [], []
    for g in range(6):
        names = [f"g{g}m{i}" for i in range(5)]
        for n in names:
            sites = [f"c{j}" for j in range(rng.randint(0, 2))]
            calls += [(n, s, rng.choice([*names, *names, None, "missing"])) for s in sites for _ in range(rng.randint(1, 2))]
            starts, ends = [("", 0), ("", 1), *[(s, RESULT) for s in sites]], [("", RETURN), ("", SINK), *[(s, p) for s in sites for p in (0, 1)]]
            flows += [(n, *rng.choice(starts), *rng.choice(ends), rng.choice([ALL, 1, 6, ALL & ~3, 0])) for _ in range(6)]
    want = brute(flows, calls)
    facts = parameter_facts(spark.createDataFrame([*flows, flows[0]], FLOWS), spark.createDataFrame([*calls, *calls[:2]], CALLS))
    assert {(r["symbol"], r["param"], r["site"], r["pos"]): r["mask"] for r in facts.collect()} == want
    got = {r["symbol"]: r for r in summaries(facts).collect()}
    assert set(got) == {s for s, *_ in want}
    for s, r in got.items():
        for i in range(len(r["returns"])):
            assert r["returns"][i] == want.get((s, i, "", RETURN), 0) and r["sinks"][i] == want.get((s, i, "", SINK), 0)


def test_callers_are_kept_apart(spark):
    """A helper that both call: only the caller that hands it its parameter has a way to the sink after the call; a walk over the same ports without summaries mixes them."""
    flows = [("helper", "", 0, "", RETURN, ALL), ("one", "", 0, "a", 0, ALL), ("one", "a", RESULT, "", RETURN, ALL), ("two", "", 0, "", RETURN, 0), ("two", "b", RESULT, "", SINK, ALL)]
    calls = [("one", "a", "helper"), ("two", "b", "helper")]
    got = {r["symbol"]: (r["returns"], r["sinks"]) for r in summaries(parameter_facts(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(calls, CALLS))).collect()}
    assert got == {"helper": ([ALL], [0]), "one": ([ALL], [0]), "two": ([0], [0])}
    port = lambda s, site, pos: f"{s}/{site}/{pos}"
    edges = [("p", port(s, a, b), "p", port(s, c, d), 100, ALL & ~k) for s, a, b, c, d, k in flows]
    edges += [e for s, site, callee in calls for e in (("p", port(s, site, 0), "p", port(callee, "", 0), 100, 0), ("p", port(callee, "", RETURN), "p", port(s, site, RESULT), 100, 0))]
    walked = taint_walk(spark.createDataFrame(edges, "src_kind string, src string, dst_kind string, dst string, conf int, clears int"), spark.createDataFrame([("one", "p", port("one", "", 0), ALL)], "root string, kind string, key string, mask int"))
    reached = {r["key"] for r in walked.collect()}
    assert port("one", "", RETURN) in reached and port("two", "", SINK) in reached


def test_recursion_and_nothing(spark):
    flows = [("f", "", 0, "r", 0, ALL & ~mask("sql")), ("f", "r", RESULT, "", RETURN, ALL), ("f", "", 0, "", SINK, mask("sql", "html")), ("f", "", 1, "", RETURN, mask("log")), ("f", "", 0, "r", 1, ALL)]
    facts = parameter_facts(spark.createDataFrame(flows, FLOWS), spark.createDataFrame([("f", "r", "f")], CALLS))
    assert [(r["returns"], r["sinks"]) for r in summaries(facts).collect()] == [([mask("log"), mask("log")], [mask("sql", "html"), 0])]
    assert parameter_facts(spark.createDataFrame([], FLOWS), spark.createDataFrame([], CALLS)).count() == 0


def test_stored_taint_over_two_columns_and_in_a_circle(spark):
    edges = spark.createDataFrame([("m", 1, "m", 2, 90, 0), ("m", 3, "m", 4, 80, mask("html")), ("m", 5, "m", 6, 70, 0)], "src_kind string, src long, dst_kind string, dst long, conf int, clears int")
    sources = spark.createDataFrame([("in", "m", 1, mask("sql", "html", "log"))], "root string, kind string, key long, mask int")
    writes = spark.createDataFrame([("m", 2, "a", mask("sql", "html")), ("m", 4, "b", ALL), ("m", 6, "a", ALL), ("m", 9, "c", ALL)], "kind string, key long, column string, keeps int")
    reads = spark.createDataFrame([("a", "m", 3), ("a", "m", 3), ("b", "m", 5), ("c", "m", 7)], "column string, kind string, key long")
    got = {(r["root"], r["key"], r["mask"], r["generation"]) for r in stored_taint(edges, sources, writes, reads).collect()}
    both, sql = mask("sql", "html"), mask("sql")
    assert got == {("in", 1, both | mask("log"), 1), ("in", 2, both | mask("log"), 1), ("stored:a", 3, both, 2), ("stored:a", 4, sql, 2), ("stored:b", 5, sql, 3), ("stored:b", 6, sql, 3)}
    assert stored_taint(edges, sources.limit(0), writes, reads).count() == 0
