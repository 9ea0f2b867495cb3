"""Edges and facts of calls, templates and routes on made inputs."""

import pytest
from pyspark.sql import functions as F

from graphweave.functions.calls import answers_html, argument, bound_class, clears, returned_taint, unsafe_write, with_markers
from graphweave.functions.identity import node_id
from graphweave.functions.masks import ALL, mask
from graphweave.operators import build


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_flatten_keeps_what_is_unresolved(spark):
    edges = made(spark, [("CALLS", "m", "1", "m", "2", 60), ("CALLS", "m", "1", "m", "2", 90), ("USES", "m", "1", "t", "9", 100), ("USES", "x", "7", "m", "1", 100), ("USES", "x", "7", "x", None, 100), ("USES", "m", "1", "m", "1", None)], "kind string, src_kind string, src string, dst_kind string, dst string, conf int")
    nodes = made(spark, [("m", "1"), ("m", "1"), ("m", "2"), ("t", "8"), ("x", None)], "kind string, key string")
    got = build.flatten(edges, nodes)
    assert sorted((r["kind"], r["conf"] or 0, r["missing"] or "") for r in got.collect()) == [("CALLS", 90, ""), ("USES", 0, ""), ("USES", 100, "both"), ("USES", 100, "source"), ("USES", 100, "target")]
    ids = nodes.where("key = '1'").select(node_id(F.col("kind"), F.col("key"))).first()[0]
    assert {r["src_id"] for r in got.where("kind = 'CALLS'").collect()} == {ids}
    assert build.flatten(edges.limit(0), nodes).count() == 0 and build.flatten(edges, nodes.limit(0)).where("missing = 'both'").count() == 5


def test_traits_and_duck_calls(spark):
    types = made(spark, [("a", ["t", "u", "t", None]), ("b", []), ("c", None)], "type string, traits array<string>")
    assert rows(build.uses_trait(types)) == [("a", "t"), ("a", "u")]
    calls = made(spark, [("c1", "run"), ("c1", "run"), ("c2", "one"), ("c3", "none"), ("c4", None)], "call string, method string")
    methods = made(spark, [("A", "run"), ("B", "run"), ("C", "run"), ("C", "run"), ("A", "one")], "owner string, name string")
    assert rows(build.duck_calls(calls, methods)) == [("c1", "run", "A", 13), ("c1", "run", "B", 13), ("c1", "run", "C", 13), ("c2", "one", "A", 40)]


def test_template_data_through_loops_includes_and_components(spark):
    data = made(spark, [("v", "page", "items", ALL), ("v", "page", "title", mask("sql")), ("w", "card", "item", mask("html"))], "root string, template string, variable string, mask int")
    loops = made(spark, [("page", "items", "item")], "template string, collection string, variable string")
    passes = made(spark, [("page", "item", "card", "item", 0), ("page", "title", "card", "title", 0), ("card", "item", "page", "items", None), ("card", "item", "safe", "item", mask("html"))], "src string, src_variable string, dst string, dst_variable string, clears int")
    echoes = made(spark, [("page", "item", 3, "raw"), ("page", "title", 4, "raw"), ("card", "item", 1, "escaped"), ("card", "item", 2, "raw"), ("card", "item", 2, "raw"), ("safe", "item", 5, "raw"), ("safe", "item", 6, "script"), ("other", "item", 9, "raw")], "template string, variable string, line int, context string")
    got = rows(build.template_echoes(data, loops, passes, echoes))
    assert got == [("v", "card", "item", 2, "raw-echo"), ("v", "page", "item", 3, "raw-echo"), ("v", "safe", "item", 6, "js-echo"), ("w", "card", "item", 2, "raw-echo"), ("w", "page", "item", 3, "raw-echo")]
    assert build.template_echoes(data.limit(0), loops, passes, echoes).count() == 0


def test_gates(spark):
    routes = made(spark, [(1, ["auth", "Admin:x"]), (2, ["Log"]), (3, ["?"]), (4, ["can:edit"]), (5, []), (6, None), (7, ["Redirects"]), (8, [None, "Missing"]), (9, ["Abort404"])], "route int, middleware array<string>")
    handlers = made(spark, [("Admin", "check", None), ("Admin", "abort", "403"), ("Log", "write", "403"), ("Redirects", "redirectTo", None), ("Abort404", "abort", "404")], "class string, call string, argument string")
    assert rows(build.gated(routes, handlers)) == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (7, True), (8, False), (9, False)]


def test_arguments(spark):
    schema = "i int, args array<struct<name:string,value:string>>"
    df = made(spark, [(1, [(None, "a"), (None, "b")]), (2, [("command", "n"), (None, "a"), (None, "b")]), (3, [("other", "o"), (None, "a")]), (4, []), (5, None), (6, [(None, "a"), ("command", "x"), ("command", "y")])], schema)
    got = {r["i"]: (r["zero"], r["one"]) for r in df.select("i", argument(F.col("args"), "command", 0)["value"].alias("zero"), argument(F.col("args"), "command", 1)["value"].alias("one")).collect()}
    assert got == {1: ("a", "b"), 2: ("n", "n"), 3: ("a", None), 4: (None, None), 5: (None, None), 6: ("x", "x")}


@pytest.mark.parametrize(("chain", "want"), [(["response"], True), (["this", "view", "with"], True), (["response", "json"], False), (["view", "jsonp"], False), (["request"], False), ([], False), (None, False), ([None, "view"], True)])
def test_response_chains(spark, chain, want):
    assert made(spark, [(chain,)], "c array<string>").select(answers_html(F.col("c"))).first()[0] is want


def test_scopes_and_writes(spark):
    scopes = made(spark, [("self", False), ("self", True), ("static", True), ("parent", False), ("Other", False), (None, False)], "scope string, trait boolean")
    got = [r[0] for r in scopes.select(bound_class(F.col("scope"), F.lit("L"), F.lit("R"), F.lit(None).cast("string"), F.col("trait"))).collect()]
    assert got == ["L", "R", "R", None, "Other", None]
    writes = made(spark, [(0, 1, True, "open", False), (0, 1, True, "guarded", False), (0, 1, True, "guarded", True), (1, 1, True, "open", False), (0, 1, False, "open", False), (None, 1, True, "open", False), (0, 1, True, None, False), (0, None, True, "open", False)], "i int, n int, tainted boolean, protection string, bypass boolean")
    got = [r[0] for r in writes.select(unsafe_write(*[F.col(c) for c in writes.columns])).collect()]
    assert got == [True, False, True, False, False, None, None, True]


def test_markers(spark):
    steps = made(spark, [([(2, False), (1, True)],), ([],)], "s array<struct<step:int,weak:boolean>>")
    got = [[tuple(x) for x in r[0]] for r in steps.select(with_markers(F.col("s"))).collect()]
    assert got == [[(1, "call"), (1, "weak-control"), (2, "call")], []]


def test_sanitizers_that_need_a_flag(spark):
    schema = "i int, call string, args array<struct<value:string,taint:int>>"
    calls = [
        ("json_encode", [("$x", ALL), ("JSON_HEX_TAG | JSON_HEX_APOS", None)], mask("js", "html")), ("json_encode", [("$x", ALL), ("JSON_HEX_TAGS", None)], 0), ("json_encode", [("$x", ALL)], 0),
        ("intval", [("$x", ALL)], mask("sql", "html", "path")), ("(int)", [("$x", ALL)], mask("sql", "html")), ("Js::from", [("$x", ALL)], mask("js", "html")),
        ("trim", [("JSON_HEX_TAG", ALL)], 0), ("basename", [(None, None), ("$y", mask("path", "sql"))], mask("path")), ("e", [], mask("html")), ("e", None, mask("html")), (None, [("$x", ALL)], 0),
    ]
    df = made(spark, [(i, call, args) for i, (call, args, _) in enumerate(calls)], schema)
    got = {r["i"]: (r["c"], r["t"]) for r in df.select("i", clears(F.col("call"), F.col("args")).alias("c"), returned_taint(F.col("call"), F.col("args")).alias("t")).collect()}
    for i, (_, args, bits) in enumerate(calls):
        every = 0
        for _, taint in args or []:
            every |= taint or 0
        assert got[i] == (bits, every & ~bits)
        assert not bits & mask("code")
