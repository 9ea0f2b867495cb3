"""Nested configuration, flattened and merged."""

import pytest

from graphweave.operators.config import deep_merged, environment, flattened


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_flattened(spark):
    configs = [(1, '{"a": {"b": 1, "c": {"d": "x", "e": null}}, "f": [1, {"g": 2}], "h": {}, "i": true}'), (2, "{}"), (3, None), (4, "no json"), (5, '{"a": "plain"}'), (5, '{"a": "plain"}')]
    got = flattened(spark.createDataFrame(configs, "id int, config string"))
    assert rows(got) == [(1, "a.b", "1"), (1, "a.c.d", "x"), (1, "a.c.e", None), (1, "f", '[1,{"g":2}]'), (1, "i", "true"), (5, "a", "plain"), (5, "a", "plain")]
    deep = '{"a":' * 6 + "1" + "}" * 6
    with pytest.raises(RuntimeError):
        flattened(spark.createDataFrame([(1, deep)], "id int, config string"), most_depth=5)
    assert flattened(spark.createDataFrame([], "id int, config string")).count() == 0


def test_environment(spark):
    flat = spark.createDataFrame([("a", "1", "A"), ("b", "2", "B"), ("c", "3", None), ("d", "4", "D"), ("e", None, "E"), ("f", "5", "F")], "path string, value string, env_name string")
    env = spark.createDataFrame([("A", "x"), ("D", "TRUE"), ("E", "set"), ("F", "(null)"), ("Z", "z"), (None, "n")], "name string, text string")
    assert rows(environment(flat, env).select("path", "value")) == [("a", "x"), ("b", "2"), ("c", "3"), ("d", "true"), ("e", "set"), ("f", None)]


def test_deep_merge(spark):
    flat = [
        ("u", 1, "app.name", "one"), ("u", 1, "app.debug", "true"), ("u", 2, "app.name", "two"), ("u", 1, "db", "file"), ("u", 3, "db.host", "h"), ("u", 2, "mail.from.name", "n"), ("u", 3, "mail.from", "flat"), ("u", 2, "mail.to", "t"),
        ("u", 1, "x", "1"), ("u", 2, "x.y", "2"), ("u", 3, "x", None), ("u", 1, "appendix", "kept"), ("v", 1, "app.name", "other"), ("v", 1, "app.name", "other"), ("u", 4, "q.r", "late"), ("u", 4, "q", "same rank"),
    ]
    got = rows(deep_merged(spark.createDataFrame(flat, "who string, layer int, path string, value string"), ["who"], ["layer"]))
    assert [r for r in got if not r[1].startswith("q")] == sorted([
        ("u", "app.debug", "true"), ("u", "app.name", "two"), ("u", "appendix", "kept"), ("u", "db.host", "h"), ("u", "mail.from", "flat"), ("u", "mail.to", "t"), ("u", "x", None), ("v", "app.name", "other"),
    ], key=str)
    assert [r[1] for r in got if r[1].startswith("q")] == ["q", "q.r"]
