"""The code-graph relations as views over the star-schema tables.

Regions, nations, customers and suppliers declare each other; a customer is an entry point that
handles orders; an order calls parts through its lines. Confidence is in whole hundredths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.identity import node_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: kind, table, key column, name column
NODE_TABLES = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("order", "orders", "o_orderkey", "o_orderstatus"),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, kind, key, name``, one row per declared symbol."""
    out = None
    for kind, source, key, name in NODE_TABLES:
        rows = table(spark, sf_dir, source).select(node_id(F.lit(kind), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, key`` of every declared symbol, as often as it is declared."""
    out = None
    for kind, source, key, _ in NODE_TABLES:
        rows = table(spark, sf_dir, source).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edge_parts(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    """The edges by kinds of their ends: source kind, target kind and ``src_kind, src, dst_kind, dst, kind, conf``."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def edge(df: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, kind: str, conf=F.lit(100)) -> tuple[str, str, DataFrame]:
        rows = df.select(F.lit(src_kind).alias("src_kind"), F.col(src).cast("long").alias("src"), F.lit(dst_kind).alias("dst_kind"), F.col(dst).cast("long").alias("dst"), F.lit(kind).alias("kind"), conf.cast("int").alias("conf"))
        return src_kind, dst_kind, rows

    surest = F.max(100 - F.round(100 * F.col("l_discount"))).alias("conf")
    return [
        edge(nation, "region", "n_regionkey", "nation", "n_nationkey", "DECLARES"),
        edge(customer, "nation", "c_nationkey", "customer", "c_custkey", "DECLARES"),
        edge(supplier, "nation", "s_nationkey", "supplier", "s_suppkey", "DECLARES"),
        edge(orders, "customer", "o_custkey", "order", "o_orderkey", "HANDLES"),
        edge(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(surest), "order", "l_orderkey", "part", "l_partkey", "CALLS", F.col("conf")),
    ]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_kind, src, dst_kind, dst, kind, conf``; several calls between the same two count by the surest."""
    return reduce(DataFrame.unionByName, [rows for _, _, rows in edge_parts(spark, sf_dir)])


def part_calls(spark: SparkSession, sf_dir: str, back: float = 0.05) -> DataFrame:
    """``src, dst, conf``: parts that call each other, a graph with cycles. A returned line with a discount of 0.09 or more calls the part of the next line of its order;
    where its tax is ``back`` or more, that part calls back. Several calls between two parts count by the surest (50 and the quantity)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    first = line.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09))
    second = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    calls = first.join(second, ["l_orderkey", "l_linenumber"]).where("l_partkey != dst").select(F.col("l_partkey").alias("src"), "dst", (50 + F.col("l_quantity")).cast("int").alias("conf"), "l_tax")
    every = calls.select("src", "dst", "conf").union(calls.where(F.col("l_tax") >= back).select("dst", "src", "conf"))
    return every.groupBy("src", "dst").agg(F.max("conf").alias("conf"))


def part_calls_sql(back: float = 0.05) -> str:
    """The same in SQL."""
    return f"""
SELECT src, dst, max(conf) AS conf FROM (
  SELECT CASE WHEN turn THEN b.l_partkey ELSE a.l_partkey END AS src, CASE WHEN turn THEN a.l_partkey ELSE b.l_partkey END AS dst, CAST(50 + a.l_quantity AS INTEGER) AS conf
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1, (VALUES (false), (true)) AS t(turn)
  WHERE a.l_returnflag = 'R' AND a.l_discount >= 0.09 AND a.l_partkey <> b.l_partkey AND (NOT turn OR a.l_tax >= {back})) GROUP BY src, dst"""
