import hashlib
import re

import duckdb
import pytest

from graphweave.plans.registry import QUERIES, SQL
from tests.compare import duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    other_columns, other_rows = duck_rows(SQL[name], DATA)
    assert columns == other_columns
    assert rows == other_rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_choke_point_in_a_region(spark, tmp_path):
    """Callers in two nations of one region meet in the region, those of two regions in the root."""
    made = {
        "nation": ([(1, 7), (2, 7), (3, 8)], "n_nationkey int, n_regionkey int"),
        "customer": ([(10, 1), (20, 2), (30, 3), (40, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(100 + c, c) for c in (10, 20, 30, 40)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(110, 1), (120, 1), (110, 2), (130, 2), (110, 3), (140, 3), (120, 4)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in QUERIES["dominator_choke_point"](spark, str(tmp_path)).collect()}
    assert got == {(1, "region", 7), (2, "root", -1), (3, "nation", 1), (4, "customer", 20)}


def test_changed_parts_are_scanned_again_whatever_their_kind(spark, tmp_path):
    """A change shows in the digest also of a part whose kind is the first and that calls no even part. Parts without a name, a known brand, a row or a key, and one with two rows, are as the SQL has them."""

    def named(key, changed):
        return next(n for n in map(str, range(1000)) if (hashlib.sha1(f"{n}{key}".encode()).hexdigest()[0] == "0") == changed)

    brands = [(1, False, "Brand#3"), (2, True, "Brand#12"), (3, True, "Brand#24"), (5, False, "Brand#2"), (6, False, None), (7, True, "Brand#99"), (8, False, "Brand#1"), (9, False, None), (10, False, "Brand#4"), (10, True, "Brand#6")]
    brands += [(13, False, "Brand#1"), (14, False, "Brand#8"), (15, True, None)]
    parts = [(key, named(key, changed), brand) for key, changed, brand in brands] + [(4, None, "Brand#5"), (None, "x", "Brand#7"), (None, "x", "Brand#8"), (None, "x", None)]
    calls = [(1, 2), (3, 13), (4, 14), (4, 13), (5, 6), (6, 7), (7, 8), (8, 11), (11, 5), (9, 12), (12, 10)]
    lines = [(order, n + 1, part, 1.0, 0.1, 0.0, "R" if n == 0 else "N") for order, call in enumerate(calls) for n, part in enumerate(call)]
    con = duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR)")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR)")
    for name, made in (("part", parts), ("lineitem", lines)):
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(made[0]))})", made)
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    columns, rows = spark_rows(QUERIES["incremental_scan"](spark, str(tmp_path)))
    assert (columns, rows) == duck_rows(SQL["incremental_scan"], str(tmp_path))
    assert {node: (int(mask), touched == "True") for mask, node, touched in rows} == {
        "1": (8 | 1, True), "2": (1, True), "3": (1 | 2, True), "4": (32 | 256 | 2, False), "13": (2, False), "14": (256, False),
        **{n: (4 | 2, True) for n in ("5", "6", "7", "8", "11")}, **{n: (16 | 64, True) for n in ("9", "10", "12")}, "~": (128 | 256, False),
    }


def odd_calls(folder):
    """Tables of calls with repeated rows, a hot part, parts without a name, two rows of one part, a call without a flag, one without a discount beside one with it, and keys whose texts are not in their order."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_mktsegment VARCHAR)")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderpriority VARCHAR)")
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_type VARCHAR, p_brand VARCHAR, p_size INT)")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR)")
    customers = [(c, f"c{c}") for c in (2, 9, 10, 12, 120)] + [(9, "c9")]
    orders = [(o, (2, 9, 10, 12, 120, 7)[o % 6], "OFP"[o % 3], ("1-URGENT", "3-MEDIUM")[o % 2]) for o in range(1, 40)] + [(8, 10, "P", "1-URGENT")]
    parts = [(1, "hot", "SMALL", "b1", 1), (2, None, "LARGE", "b2", 1), (2, None, "SMALL", "b2", 1), (3, "two", "LARGE", "b3", 1), (3, "two", "SMALL", "b3", 1), (4, "four", None, None, 13), (5, "five", "SMALL", "b5", 1), (6, "six", "SMALL", "b6", 1)]
    lines = [(o, 1 + i, p, 1.0, (o * p) % 11 / 100, 0.0, "RAN"[(o + i) % 3]) for o in range(1, 45) for i, p in enumerate((1, 1 + o % 7, 1))]
    lines += [(8, 9, 6, 1.0, None, 0.0, "R"), (8, 8, 6, 1.0, 0.07, 0.0, "R"), (9, 9, 6, 1.0, 0.06, 0.0, None), (10, 9, 6, 1.0, 0.01, 0.0, None), (11, 9, 6, 1.0, 0.10, 0.0, "A"), (11, 8, 6, 1.0, 0.10, 0.0, "A")]
    made = {"customer": [(*c, 1, "BUILDING") for c in customers], "orders": orders, "part": parts, "lineitem": lines}
    for name, rows in made.items():
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")


@pytest.mark.parametrize("name", ["evidence_paths", "findings_assembled"])
def test_paths_of_odd_calls_equal_the_sql_and_only_keys_travel(spark, tmp_path, name):
    odd_calls(tmp_path)
    found = QUERIES[name](spark, str(tmp_path))
    columns, rows = spark_rows(found)
    assert (columns, rows) == duck_rows(SQL[name], str(tmp_path)) and rows
    plan = found._sc._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, DATA)._jdf.queryExecution(), "formatted")
    moved = [re.findall(r"(\w+)#", columns) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    # Neither steps nor texts of paths are shuffled, but for those of the findings that are sorted.
    assert moved and all("fingerprint" in columns or not {"steps", "text", "path", "order"} & set(columns) for columns in moved)
