"""Graph queries: identity, building, resolution, reachability. Each has its SQL beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweave.functions.identity import digest16, node_id
from graphweave.operators.ranking import first_of
from graphweave.operators.scratch import numbered
from graphweave.operators.traverse import best_paths, climb, reach
from graphweave.sources.driver_tables import NODE_TABLES, edge_parts, edges, node_keys, nodes, table

QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NODES = " UNION ".join(
    f"SELECT substr(sha1(concat_ws('|', '1', '{kind}', CAST({key} AS VARCHAR), '')), 1, 16) AS id, '{kind}' AS kind, CAST({key} AS BIGINT) AS key, {name} AS name FROM {source}"
    for kind, source, key, name in [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", "o_orderstatus")]
)
_EDGES = """
SELECT 'region' AS src_kind, CAST(n_regionkey AS BIGINT) AS src, 'nation' AS dst_kind, CAST(n_nationkey AS BIGINT) AS dst, 'DECLARES' AS kind, 100 AS conf FROM nation
UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey, 'DECLARES', 100 FROM customer
UNION ALL SELECT 'nation', s_nationkey, 'supplier', s_suppkey, 'DECLARES', 100 FROM supplier
UNION ALL SELECT 'customer', o_custkey, 'order', o_orderkey, 'HANDLES', 100 FROM orders
UNION ALL SELECT 'order', l_orderkey, 'part', l_partkey, 'CALLS', CAST(max(100 - round(100 * l_discount)) AS INTEGER) FROM lineitem GROUP BY l_orderkey, l_partkey
"""


@registered(_NODES)
def node_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir)


@registered(f"""
WITH n AS ({_NODES}), e AS ({_EDGES})
SELECT a.id AS src_id, b.id AS dst_id, e.kind, CAST(e.conf AS INTEGER) AS conf
FROM e JOIN n a ON a.kind = e.src_kind AND a.key = e.src JOIN n b ON b.kind = e.dst_kind AND b.key = e.dst
""")
def graph_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are both declared. Ids are digests of kind and key, so they are computed in place; the joins only ask whether an end exists."""
    keys = {kind: table(spark, sf_dir, source).select(F.col(key).cast("long").alias("key")) for kind, source, key, _ in NODE_TABLES}
    declared = lambda rows, end, kind: rows.join(keys[kind].withColumnRenamed("key", end), end, "left_semi")
    found = reduce(DataFrame.unionByName, [declared(declared(rows, "src", a), "dst", b) for a, b, rows in edge_parts(spark, sf_dir)])
    return found.select(node_id(F.col("src_kind"), F.col("src")).alias("src_id"), node_id(F.col("dst_kind"), F.col("dst")).alias("dst_id"), "kind", "conf")


@registered(f"""
WITH e AS ({_EDGES}), n AS ({_NODES})
SELECT e.kind, count(*) AS attempts, count(n.id) AS resolved, count(*) - count(n.id) AS unresolved
FROM e LEFT JOIN n ON n.kind = e.dst_kind AND n.key = e.dst GROUP BY e.kind
""")
def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = node_keys(spark, sf_dir).distinct().select(F.col("kind").alias("dst_kind"), F.col("key").alias("dst"), F.lit(1).alias("id"))
    found = edges(spark, sf_dir).join(n, ["dst_kind", "dst"], "left")
    return found.groupBy("kind").agg(F.count("*").alias("attempts"), F.count("id").alias("resolved"), (F.count("*") - F.count("id")).alias("unresolved"))


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@registered("""
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM p GROUP BY l_partkey),
calls AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT c.l_orderkey, c.l_partkey, p.l_suppkey, n.n AS candidates, CAST(CASE WHEN n.n = 1 THEN 9000 ELSE 6000 // n.n END AS BIGINT) AS conf_bp
FROM calls c JOIN n ON n.l_partkey = c.l_partkey JOIN p ON p.l_partkey = c.l_partkey
""")
def call_resolution_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _providers(spark, sf_dir)
    counted = p.join(p.groupBy("l_partkey").agg(F.count("*").alias("candidates")), "l_partkey")
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    conf = F.when(F.col("candidates") == 1, 9000).otherwise(F.expr("6000 DIV candidates")).cast("long")
    return calls.join(counted, "l_partkey").select("l_orderkey", "l_partkey", "l_suppkey", "candidates", conf.alias("conf_bp"))


@registered("""
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS bindings, CAST(4000 // count(*) OVER (PARTITION BY l_partkey) AS BIGINT) AS duck_bp FROM p
""")
def binding_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("l_partkey"))
    return _providers(spark, sf_dir).withColumn("bindings", n).withColumn("duck_bp", F.expr("4000 DIV bindings").cast("long"))


@registered("""
SELECT c.c_custkey, coalesce(r.r_name, n.n_name, c.c_mktsegment) AS concrete, CASE WHEN r.r_name IS NOT NULL THEN 2 WHEN n.n_name IS NOT NULL THEN 1 ELSE 0 END AS hops
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 3 <> 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey % 2 = 0
""")
def facade_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    r = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0")
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    hops = F.when(F.col("r_name").isNotNull(), 2).when(F.col("n_name").isNotNull(), 1).otherwise(0)
    return out.select("c_custkey", F.coalesce("r_name", "n_name", "c_mktsegment").alias("concrete"), hops.alias("hops"))


@registered("""
WITH c AS (SELECT DISTINCT l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS level FROM lineitem),
s AS (SELECT l_partkey, level, count(*) AS n, min(l_suppkey) AS owner FROM c GROUP BY l_partkey, level),
f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY level) AS rn FROM s)
SELECT l_partkey, level, CASE WHEN level = 2 AND n > 1 THEN NULL ELSE owner END AS owner, level = 2 AND n > 1 AS collision FROM f WHERE rn = 1
""")
def method_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own definition before composed ones before inherited ones; several at the composed level collide and stay unresolved."""
    level = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3).alias("level")
    c = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", level).distinct()
    s = c.groupBy("l_partkey", "level").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("owner"))
    f = first_of(s, ["l_partkey"], [F.col("level")])
    collision = (F.col("level") == 2) & (F.col("n") > 1)
    return f.select("l_partkey", "level", F.when(~collision, F.col("owner")).alias("owner"), collision.alias("collision"))


@registered("""
WITH RECURSIVE p AS (SELECT p_partkey AS child, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 10 = 1 THEN -1 ELSE p_partkey // 4 END AS parent FROM part),
up AS (SELECT child, child AS top, parent AS next, 0 AS steps FROM p
       UNION ALL SELECT up.child, p.child, p.parent, up.steps + 1 FROM up JOIN p ON p.child = up.next WHERE up.steps < 12)
SELECT child, top, steps, next IS NULL AS complete FROM up WHERE steps < 12 AND (next IS NULL OR next NOT IN (SELECT child FROM p))
UNION ALL SELECT child, top, steps, false FROM up WHERE steps = 12
""")
def ancestry_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.expr("p_size % 9 = 0"), None).when(F.expr("p_size % 10 = 1"), -1).otherwise(F.expr("p_partkey DIV 4"))
    return climb(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), parent.cast("long").alias("parent")), 12)


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.col("r_name").alias("root"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("key"))
    return reach(edges(spark, sf_dir), roots, 5)


_REACHED = f"""
WITH RECURSIVE e AS ({_EDGES}),
w AS (SELECT r_name AS root, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS key, 0 AS depth, 100 AS conf FROM region
      UNION SELECT w.root, e.dst_kind, e.dst, w.depth + 1, least(w.conf, e.conf) FROM w JOIN e ON e.src_kind = w.kind AND e.src = w.key WHERE w.depth < 5),
s AS (SELECT root, kind, key, depth, max(conf) AS conf FROM w GROUP BY root, kind, key, depth)
"""


@registered(_REACHED + "SELECT root, depth, kind, count(*) AS n, CAST(min(conf) AS INTEGER) AS weakest, CAST(sum(conf) AS BIGINT) AS total_conf FROM s GROUP BY root, depth, kind")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what each root reaches, by depth and kind, with the surest path's confidence."""
    return _reached(spark, sf_dir).groupBy("root", "depth", "kind").agg(F.count("*").alias("n"), F.min("conf").alias("weakest"), F.sum("conf").alias("total_conf"))


@registered(_REACHED + ", b AS (SELECT *, row_number() OVER (PARTITION BY root, kind, key ORDER BY conf DESC, depth) AS rn FROM s) SELECT root, kind, key, CAST(conf AS INTEGER) AS conf, depth FROM b WHERE rn = 1 AND kind IN ('part', 'supplier')")
def reachable_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_paths(_reached(spark, sf_dir)).where("kind IN ('part', 'supplier')")


@registered("""
SELECT l.l_partkey, bool_or(o.o_orderstatus = 'O') AS any_http, bool_or(o.o_orderpriority LIKE '1-%') AS any_unauthenticated, count(*) AS paths, CAST(min(100 - round(100 * l.l_discount)) AS INTEGER) AS weakest
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey
""")
def reachability_unauthenticated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_partkey").agg(
        F.bool_or(F.col("o_orderstatus") == "O").alias("any_http"), F.bool_or(F.col("o_orderpriority").startswith("1-")).alias("any_unauthenticated"),
        F.count("*").alias("paths"), F.min(100 - F.round(100 * F.col("l_discount"))).cast("int").alias("weakest"),
    )


@registered("""
WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
changed AS (SELECT p_partkey FROM part WHERE substr(sha1(concat_ws('|', p_name, CAST(p_size AS VARCHAR))), 1, 1) IN ('0', '1')),
o AS (SELECT DISTINCT f.l_orderkey AS k FROM f JOIN changed c ON c.p_partkey = f.l_partkey),
c AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN o ON o.k = o_orderkey)
SELECT 'part' AS kind, p_partkey AS key FROM changed UNION ALL SELECT 'order', k FROM o UNION ALL SELECT 'customer', k FROM c
""")
def incremental_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose digest changed and all their callers, up to the entry points."""
    changed = table(spark, sf_dir, "part").where(F.substring(F.sha1(F.concat_ws("|", "p_name", F.col("p_size").cast("string"))), 1, 1).isin("0", "1"))
    parts = changed.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"))
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key")).distinct()
    callers = calls.join(parts, "key", "left_semi").select(F.lit("order").alias("kind"), F.col("l_orderkey").alias("key")).distinct()
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("key"))
    entries = orders.join(callers, "key", "left_semi").select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("key")).distinct()
    return parts.unionByName(callers).unionByName(entries)


@registered("""
WITH u AS (SELECT DISTINCT l.l_partkey, c.c_nationkey, c.c_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT l_partkey, CASE WHEN count(DISTINCT c_custkey) = 1 THEN 'customer' WHEN count(DISTINCT c_nationkey) = 1 THEN 'nation' ELSE 'root' END AS choke,
       CAST(CASE WHEN count(DISTINCT c_custkey) = 1 THEN min(c_custkey) WHEN count(DISTINCT c_nationkey) = 1 THEN min(c_nationkey) ELSE -1 END AS BIGINT) AS choke_key
FROM u GROUP BY l_partkey
""")
def dominator_choke_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest node above the orders that every path to a part passes: in a layered graph, the last layer where its callers meet."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))
    u = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    u = u.join(F.broadcast(r), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    # A nation without a row or region hangs from the root itself.
    layers = [("customer", "c_custkey"), ("nation", "c_nationkey"), ("region", "n_regionkey")]
    ends = u.groupBy("l_partkey").agg(
        *[f(key).alias(f"{kind}_{end}") for kind, key in layers for end, f in (("least", F.min), ("most", F.max))],
        F.bool_or(F.col("n_regionkey").isNull()).alias("loose"),
    )
    choke, at = F.lit("root"), F.lit(-1).cast("long")
    for kind, _ in reversed(layers):
        one = F.col(f"{kind}_least") == F.col(f"{kind}_most")
        if kind == "region":
            one &= ~F.col("loose")
        choke, at = F.when(one, kind).otherwise(choke), F.when(one, F.col(f"{kind}_least").cast("long")).otherwise(at)
    return ends.select("l_partkey", choke.alias("choke"), at.alias("choke_key"))


@registered(f"WITH n AS ({_NODES}) SELECT id, kind, key, name, row_number() OVER (ORDER BY kind, name, id) AS place FROM n WHERE kind IN ('region', 'nation', 'supplier')")
def graph_export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's total order over the declared top symbols, numbered by ranges; ``graph_export_json`` covers every node and edge."""
    return numbered(nodes(spark, sf_dir).where("kind IN ('region', 'nation', 'supplier')"), ["kind", "name", "id"])


@registered("""
SELECT substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))), 1, 16) AS symbol, count(*) AS seen, min(event_id) AS first_event, max(event_id) AS last_event
FROM events GROUP BY event_type, user_id
""")
def upsert_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent: one row per symbol over all scans, the first and last that declared it."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type", "user_id").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return g.select(digest16(F.col("event_type"), F.col("user_id")).alias("symbol"), "seen", "first_event", "last_event")
