"""Loops that end by what they have seen, and say so where they do not end."""

import pytest

from graphweave.operators.resolve import nearest_base, resolve_methods, resolve_properties
from graphweave.operators.traverse import climb


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nearest_base_on_chains_cycles_and_repeats(spark):
    classes = [(i, i + 1 if i < 40 else None, i == 40) for i in range(41)]  # a chain of forty
    classes += [(100, 101, False), (101, 102, False), (102, 100, False), (110, 110, False), (120, 100, False), (130, 131, False), (131, 130, True)]
    classes += [(140, 999, False), (150, None, False), (160, None, True), (160, None, True), (170, 160, None), (180, 5, False), (180, 5, False)]
    got = dict(rows(nearest_base(spark.createDataFrame(classes, "type long, parent long, base boolean"))))
    assert got == {**{i: 40 - i for i in range(41)}, 130: 1, 131: 0, 160: 0, 170: 1, 180: 36}
    with pytest.raises(RuntimeError):
        nearest_base(spark.createDataFrame(classes, "type long, parent long, base boolean"), most_rounds=10)
    assert nearest_base(spark.createDataFrame([], "type long, parent long, base boolean")).count() == 0


def test_long_chains_resolve_or_raise(spark):
    types = spark.createDataFrame([(f"c{i}", "class", f"c{i + 1}") for i in range(12)] + [("x", "class", "y"), ("y", "class", "x")], "type string, kind string, parent string")
    none = lambda schema: spark.createDataFrame([], schema)
    uses, aliases, exclusions = none("type string, trait string"), none("type string, name string, trait string, meant string"), none("type string, name string, trait string")
    asked = spark.createDataFrame([("c0", "run"), ("x", "run")], "type string, name string")
    methods = spark.createDataFrame([("c12", "run", False)], "owner string, name string, abstract boolean")
    types = types.union(spark.createDataFrame([("c12", "class", None)], types.schema))
    got = rows(resolve_methods(types, methods, uses, aliases, exclusions, asked).select("type", "owner", "steps", "outcome"))
    assert got == [("c0", "c12", 12, "inherited"), ("x", None, None, "unknown")]
    with pytest.raises(RuntimeError):
        resolve_methods(types, methods, uses, aliases, exclusions, asked, most_rounds=5)
    properties = spark.createDataFrame([("c12", "run", "int")], "owner string, name string, declared string")
    used = none("type string, trait string, ord int")
    assert rows(resolve_properties(types, properties, used, asked).select("type", "declared", "steps")) == [("c0", "int", 12), ("x", None, None)]
    with pytest.raises(RuntimeError):
        resolve_properties(types, properties, used, asked, most_rounds=5)


def test_climb_stops_when_all_have_ended(spark):
    parents = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 99), (5, 6), (6, 5), (7, 7)], "child long, parent long")
    got = rows(climb(parents, 12))
    assert got == [(1, 3, 2, True), (2, 3, 1, True), (3, 3, 0, True), (4, 4, 0, False), (5, 5, 12, False), (6, 6, 12, False), (7, 7, 12, False)]
    acyclic = climb(parents.where("child < 5"), 500)
    assert rows(acyclic) == got[:4] and acyclic._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    assert climb(parents.limit(0), 3).count() == 0
