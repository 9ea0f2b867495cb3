"""Assembly with explicit entry kinds, globs that expire, a baseline and bare ignores."""

import datetime

import pytest
from pyspark.sql import functions as F

from graphweave.functions.patterns import glob_column, glob_pattern
from graphweave.operators.evidence import assemble, bare_ignores, ranked_paths, without_baseline
from graphweave.plans import walks

STEPS = "rule string, steps array<struct<role:string,file:string,line:long,snippet:string,entry:string,confidence:int>>"


def path(rule, file, line, *entries, conf=100):
    """One path per entry kind (null: no entry point) to a sink."""
    return [(rule, [("entry", "routes", i, f"e{i}", kind, 100), ("sink", file, line, f"{file}:{line}", None, conf)]) for i, kind in enumerate(entries)]


def run(spark, rows, globs=(), baseline=(), marks=(), day="2024-06-01"):
    rules = spark.createDataFrame([("sql", "taint", 3), ("shape", "structural", 3)], "rule string, kind string, rank int")
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    days = [(r, p, datetime.date.fromisoformat(e) if e else None) for r, p, e in globs]
    out = assemble(ranked_paths(made(rows, STEPS)), rules, made(marks, "file string, rule string, line long"), made(baseline, "fingerprint string"), 70, made(days, "rule string, pattern string, expires date"), F.lit(day).cast("date"))
    return {(r["rule"], r["file"], r["line"]): r for r in out.collect()}


def test_entry_kinds_move_severities(spark):
    rows = path("sql", "a", 1, "http", "console") + path("sql", "b", 1, "console") + path("sql", "c", 1, "unauthenticated", "console") + path("sql", "d", 1, None) + path("sql", "e", 1, "unauthenticated", conf=60) + path("shape", "f", 1, "console", conf=10) + path("other", "g", 1, "http") + [("sql", []), ("sql", None)]
    got = run(spark, rows)
    assert {f: (r["severity"], r["needs_review"], r["alternatives"]) for (_, f, _), r in got.items()} == {
        "a": ("high", False, 1), "b": ("medium", False, 0), "c": ("critical", False, 1), "d": ("high", False, 0), "e": ("high", True, 0), "f": ("high", False, 0),
    }


def test_suppressions_in_their_order(spark):
    rows = [r for f in ("app/x.php", "app/sub/y.php", "app[1]/z.php", "vendor/v.php") for r in path("sql", f, 5, "http")] + path("sql", None, 5, "http")
    files = lambda **kw: sorted(str(f) for _, f, _ in run(spark, rows, **kw))
    assert files() == ["None", "app/sub/y.php", "app/x.php", "app[1]/z.php"]
    assert files(globs=[("sql", "app/*.php", None)]) == ["None", "app[1]/z.php"]
    assert files(globs=[("sql", "app[1]/?.php", "2024-06-01")]) == ["None", "app/sub/y.php", "app/x.php"]
    assert len(files(globs=[("sql", "*", "2024-05-31"), ("shape", "*", None)])) == 4
    assert files(globs=[("sql", "app/x.php", None), ("sql", "*.php", None)], marks=[("app/x.php", "sql", 4)]) == ["None"]
    assert files(marks=[("app/x.php", "sql", 4), ("app/sub/y.php", "sql", 5), ("app[1]/z.php", "shape", 4)]) == ["None", "app/sub/y.php", "app[1]/z.php"]
    known = run(spark, rows)[("sql", "app/x.php", 5)]["fingerprint"]
    assert files(baseline=[(known,), (known,), ("unknown",), (None,)]) == ["None", "app/sub/y.php", "app[1]/z.php"]


def test_bare_ignores(spark):
    bare = spark.createDataFrame([("a", 3, "ignore"), ("a", 3, "ignore"), ("b", None, None)], "file string, line long, snippet string")
    got = {r["file"]: r for r in bare_ignores(bare, "bare-ignore", 1).collect()}
    assert set(got) == {"a", "b"} and got["a"]["severity"] == "low" and got["a"]["line"] == 3 and got["a"]["steps"][0]["role"] == "entry" and got["a"]["fingerprint"] != got["b"]["fingerprint"]


@pytest.mark.parametrize("glob", ["app/*.php", "a?c", "[x]+(y)|{z}^$.", "é*ü", "a\\b", "a b#c", ""])
def test_glob_columns_equal_glob_patterns(spark, glob):
    import re

    texts = ["app/x.php", "app/y/z.php", "abc", "ac", "[x]+(y)|{z}^$.", "é-ü", "a\\b", "a b#c", "", "app/\n.php"]
    got = spark.createDataFrame([(t, glob) for t in texts], "t string, g string").where(F.rlike("t", glob_column(F.col("g")))).collect()
    assert [r["t"] for r in got] == [t for t in texts if re.match(glob_pattern(glob), t)]


def test_sinks_beside_the_steps_and_no_baseline(spark):
    """Paths that have their sink's file and line beside their steps make the same findings, and a baseline may come later."""
    rows = path("sql", "a", 1, "http", "console") + path("sql", "a", 2, "http") + path("sql", None, 5, "console", conf=60) + path("shape", "vendor/b", 1, "http") + [("sql", []), ("sql", None)]
    rules = spark.createDataFrame([("sql", "taint", 3), ("shape", "structural", 3)], "rule string, kind string, rank int")
    marks, paths = spark.createDataFrame([], "file string, rule string, line long"), spark.createDataFrame(rows, STEPS)
    last = F.element_at("steps", -1)
    beside = paths.where(F.size("steps") > 0).select("rule", last["file"].alias("file"), last["line"].alias("line"), "steps")
    every = assemble(ranked_paths(beside), rules, marks, None)
    some = every.where("line = 2").select("fingerprint")
    shown = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert shown(every) == shown(assemble(ranked_paths(paths), rules, marks, some.limit(0)))
    assert shown(without_baseline(every, some)) == shown(assemble(ranked_paths(paths), rules, marks, some)) != []


def test_taint_findings_are_assembled_once(spark, monkeypatch):
    """The scan before, whose findings are the baseline, and the scan now have the same paths."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_type <> 'LARGE' AND p_size <> 13").orderBy("p_partkey").collect()
    old, new = (next(p["p_partkey"] for p in parts if (p["p_size"] % 9 == 0) == known and not p["p_name"].startswith(("b", "r"))) for known in (True, False))
    made = [("ASIA", "log", sink, 90, 1, [("region", 2, 4095, 100), ("part", sink, 4095, 90)]) for sink in (old, new)]
    calls = []
    monkeypatch.setattr(walks, "_winners", lambda *_: spark.createDataFrame(made, "root string, rule string, sink long, conf int, depth int, steps array<struct<kind:string,key:long,mask:int,conf:int>>"))
    monkeypatch.setattr(walks, "assemble", lambda *a, **kw: calls.append(a) or assemble(*a, **kw))
    found = walks.taint_findings(spark, "/root/testdata/sf0.001").where("rule = 'log'").collect()
    assert [r["line"] for r in found] == [new] and len(calls) == 1
