"""Queries that build edges and facts: the whole flattened graph, duck calls, echoes of templates, gated routes. Each has its SQL beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.masks import ALL, mask
from graphweave.operators import build
from graphweave.operators.config import deep_merged, flattened
from graphweave.plans.flows import values
from graphweave.sources.driver_tables import NODE_TABLES, edge_parts, node_keys, table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Middleware that is declared; routes name others, too.
_MIDDLEWARE = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@registered(f"""
WITH n AS ({" UNION ".join(f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key FROM {source}" for kind, source, key, _ in NODE_TABLES)} UNION SELECT 'trait', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0 UNION VALUES {", ".join(f"('middleware', '{m}')" for m in _MIDDLEWARE)}),
p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT l_partkey, count(*) AS n FROM p GROUP BY l_partkey),
e AS (SELECT 'DECLARES' AS kind, 'region' AS src_kind, CAST(n_regionkey AS VARCHAR) AS src, 'nation' AS dst_kind, CAST(n_nationkey AS VARCHAR) AS dst, 100 AS conf FROM nation
  UNION ALL SELECT 'DECLARES', 'nation', c_nationkey, 'customer', c_custkey, 100 FROM customer UNION ALL SELECT 'DECLARES', 'nation', s_nationkey, 'supplier', s_suppkey, 100 FROM supplier
  UNION ALL SELECT 'HANDLES', 'customer', o_custkey, 'order', o_orderkey, 100 FROM orders
  UNION ALL SELECT 'CALLS', 'order', l_orderkey, 'part', l_partkey, CAST(100 - round(100 * l_discount) AS INTEGER) FROM lineitem
  UNION ALL SELECT 'INSTANTIATES', 'order', l_orderkey, 'part', 2 * l_partkey, 100 FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'N'
  UNION ALL SELECT 'RESOLVES_TO', 'part', p.l_partkey, 'supplier', p.l_suppkey, CAST(40 // c.n AS INTEGER) FROM p JOIN c ON c.l_partkey = p.l_partkey
  UNION ALL SELECT 'USES_TRAIT', 'part', l_partkey, 'trait', l_suppkey, 100 FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10
  UNION ALL SELECT 'EXTENDS', 'part', p_partkey, 'part', CASE WHEN p_size % 10 = 1 THEN -1 ELSE p_partkey // 4 END, 100 FROM part WHERE p_size % 9 <> 0
  UNION ALL SELECT 'PROTECTED_BY', 'order', CAST(o_orderkey AS VARCHAR), 'middleware', o_orderpriority, 100 FROM orders)
SELECT e.kind, substr(sha1(concat_ws('|', '1', src_kind, src, '')), 1, 16) AS src_id, substr(sha1(concat_ws('|', '1', dst_kind, dst, '')), 1, 16) AS dst_id, CAST(max(conf) AS INTEGER) AS conf,
  CASE WHEN bool_and(a.key IS NULL) AND bool_and(b.key IS NULL) THEN 'both' WHEN bool_and(a.key IS NULL) THEN 'source' WHEN bool_and(b.key IS NULL) THEN 'target' END AS missing
FROM e LEFT JOIN n a ON a.kind = src_kind AND a.key = src LEFT JOIN n b ON b.kind = dst_kind AND b.key = dst GROUP BY e.kind, src_kind, src, dst_kind, dst
""")
def graph_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph as one table of eight kinds of edges, the unresolved ones with the end that nobody declares."""
    line, part, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")

    def edge(df: DataFrame, kind: str, src_kind: str, src, dst_kind: str, dst, conf=F.lit(100)) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(src_kind).alias("src_kind"), src.cast("string").alias("src"), F.lit(dst_kind).alias("dst_kind"), dst.cast("string").alias("dst"), conf.cast("int").alias("conf"))

    declared = [rows.select("kind", "src_kind", F.col("src").cast("string").alias("src"), "dst_kind", F.col("dst").cast("string").alias("dst"), "conf") for _, _, rows in edge_parts(spark, sf_dir)]
    traits = build.uses_trait(line.where("l_linenumber = 1 AND l_quantity < 10").select(F.col("l_partkey").alias("type"), F.array("l_suppkey", F.lit(None)).alias("traits")))
    duck = build.duck_calls(line.select(F.col("l_partkey").alias("call"), F.col("l_partkey").alias("method")), line.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")))
    parent = F.when(F.expr("p_size % 10 = 1"), F.lit(-1)).otherwise(F.expr("p_partkey DIV 4"))
    facts = [
        edge(line.where("l_linenumber = 2 AND l_returnflag = 'N'"), "INSTANTIATES", "order", F.col("l_orderkey"), "part", 2 * F.col("l_partkey")),
        edge(duck, "RESOLVES_TO", "part", F.col("call"), "supplier", F.col("owner"), F.col("conf")),
        edge(traits, "USES_TRAIT", "part", F.col("type"), "trait", F.col("trait")),
        edge(part.where("p_size % 9 <> 0"), "EXTENDS", "part", F.col("p_partkey"), "part", parent),
        edge(orders, "PROTECTED_BY", "order", F.col("o_orderkey"), "middleware", F.col("o_orderpriority")),
    ]
    nodes = node_keys(spark, sf_dir).select("kind", F.col("key").cast("string").alias("key"))
    nodes = nodes.union(table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.lit("trait"), F.col("s_suppkey").cast("string")))
    nodes = nodes.union(spark.createDataFrame([("middleware", m) for m in _MIDDLEWARE], "kind string, key string"))
    return build.flatten(reduce(DataFrame.unionByName, [*declared, *facts]), nodes)


@registered("""
WITH m AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS name FROM lineitem), c AS (SELECT DISTINCT o_custkey AS call, l_partkey AS method FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 1),
n AS (SELECT name, count(*) AS n FROM m GROUP BY name)
SELECT c.call, c.method, m.owner, CAST(40 // n.n AS INTEGER) AS conf FROM c JOIN m ON m.name = c.method JOIN n ON n.name = c.method
""")
def duck_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on receivers of unknown type with every class that has the method, at 0.4 shared among them."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("call"))
    calls = line.where("l_returnflag = 'R' AND l_linenumber = 1").join(orders, "l_orderkey").select("call", F.col("l_partkey").alias("method"))
    return build.duck_calls(calls, line.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")))


_CONTEXTS = [(f"Brand#{i}", ["raw", "script", "escaped", "raw", "escaped"][i % 5]) for i in range(1, 26)]


@registered(f"""
WITH RECURSIVE ctx(brand, context) AS (VALUES {values(_CONTEXTS)}), n AS (SELECT max(p_partkey) + 1 AS n FROM part), v AS (SELECT unnest([0, 1, 2]) AS v),
e AS MATERIALIZED (SELECT p_partkey AS src, 0 AS sv, p_partkey AS dst, 2 AS dv, 0 AS clears FROM part WHERE p_size % 4 = 0
  UNION SELECT p_partkey, v, (p_partkey * 3 + 1) % n, v, CASE WHEN p_size % 2 = 1 THEN {mask('html')} ELSE 0 END FROM part, n, v WHERE p_size % 3 = 0
  UNION SELECT p_partkey, 0, p_partkey // 2, 1, 0 FROM part WHERE p_size % 5 = 0),
w AS (SELECT p_partkey AS root, p_partkey AS t, 0 AS v, {ALL} AS m FROM part WHERE p_type = 'PROMO' AND p_size < 10 UNION SELECT p_partkey, p_partkey, 1, {mask('html')} FROM part WHERE p_type = 'PROMO' AND p_size < 10 AND p_size % 2 = 0
  UNION SELECT w.root, e.dst, e.dv, w.m & ~e.clears FROM w JOIN e ON e.src = w.t AND e.sv = w.v WHERE w.m & ~e.clears <> 0)
SELECT DISTINCT w.root, w.t AS template, 'v' || w.v AS variable, p_size AS line, CASE context WHEN 'raw' THEN 'raw-echo' ELSE 'js-echo' END AS rule
FROM w JOIN part ON p_partkey = w.t AND p_size % 3 = w.v JOIN ctx ON brand = p_brand WHERE (context = 'raw' AND w.m & {mask('html')} <> 0) OR (context = 'script' AND w.m & {mask('js')} <> 0)
""")
def template_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw echoes, and echoes into scripts, of what a view's data taints: a loop variable holds its collection, includes hand all variables on (some escaped), layouts take the first under another name."""
    p = table(spark, sf_dir, "part")
    name = lambda v: F.concat(F.lit("v"), v.cast("string"))
    views = p.where("p_type = 'PROMO' AND p_size < 10")
    bound = lambda df, v, m: df.select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("template"), F.lit(v).alias("variable"), F.lit(m).alias("mask"))
    data = bound(views, "v0", ALL).union(bound(views.where("p_size % 2 = 0"), "v1", mask("html")))
    loops = p.where("p_size % 4 = 0").select(F.col("p_partkey").alias("template"), F.lit("v0").alias("collection"), F.lit("v2").alias("variable"))
    # One row: the number of templates.
    n = F.broadcast(p.agg((F.max("p_partkey") + 1).alias("n")))
    includes = p.where("p_size % 3 = 0").crossJoin(n).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 3 + 1) % F.col("n")).alias("dst"), F.when(F.expr("p_size % 2 = 1"), mask("html")).otherwise(0).alias("clears"), F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    includes = includes.select("src", name(F.col("v")).alias("src_variable"), "dst", name(F.col("v")).alias("dst_variable"), "clears")
    layouts = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("src"), F.lit("v0").alias("src_variable"), F.expr("p_partkey DIV 2").alias("dst"), F.lit("v1").alias("dst_variable"), F.lit(0).alias("clears"))
    contexts = spark.createDataFrame(_CONTEXTS, "p_brand string, context string")
    echoes = p.join(F.broadcast(contexts), "p_brand").select(F.col("p_partkey").alias("template"), name(F.col("p_size") % 3).alias("variable"), F.col("p_size").alias("line"), "context")
    return build.template_echoes(data, loops, includes.union(layouts), echoes)


@registered("""
WITH h AS (SELECT DISTINCT event_type || CAST(user_id % 5 AS VARCHAR) AS class FROM events WHERE (event_id % 4 = 0 AND CAST(json_extract_string(props, '$.k') AS INTEGER) = 50) OR (event_id % 4 = 1 AND value > 90)),
m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '?' WHEN o_orderkey % 40 = 0 THEN 'can:update' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_orderstatus WHEN 'O' THEN 'click' WHEN 'F' THEN 'view' ELSE 'error' END || CAST(o_custkey % 5 AS VARCHAR) || ':x' END AS name FROM orders)
SELECT o_orderkey AS route, coalesce(name = '?' OR name LIKE 'can:%' OR class IS NOT NULL, false) AS gated FROM m LEFT JOIN h ON class = string_split(name, ':')[1]
""")
def gated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that some middleware of their own closes: its handler aborts with 403 or redirects; what is unresolved counts as closed."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    call = F.when(F.expr("event_id % 4 = 0"), "abort").when(F.expr("event_id % 4 = 1 AND value > 90"), "redirect").otherwise("next")
    handlers = e.select(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("class"), call.alias("call"), F.when(k == "50", " 403").otherwise(k).alias("argument"))
    o = table(spark, sf_dir, "orders")
    own = F.concat(F.when(F.col("o_orderstatus") == "O", "click").when(F.col("o_orderstatus") == "F", "view").otherwise("error"), (F.col("o_custkey") % 5).cast("string"), F.lit(":x"))
    name = F.when(F.expr("o_orderkey % 50 = 0"), "?").when(F.expr("o_orderkey % 40 = 0"), "can:update").when(F.expr("o_orderkey % 7 <> 0"), own)
    return build.gated(o.select(F.col("o_orderkey").alias("route"), F.array(name).alias("middleware")), handlers)


@registered("""
WITH e AS (SELECT user_id, event_id % 3 AS layer, event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
f AS (SELECT user_id, layer, event_id, CASE k % 4 WHEN 0 THEN 'app.' || t WHEN 1 THEN 'app.' || t || '.deep' WHEN 2 THEN t ELSE 'app' END AS path, k AS value FROM e WHERE k % 4 <> 3 OR k % 20 = 3 UNION ALL SELECT user_id, layer, event_id, 'app.' || t || '.also', event_id FROM e WHERE k % 4 = 1)
SELECT DISTINCT user_id, path, CAST(value AS VARCHAR) AS value FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.user_id = f.user_id AND (g.layer, g.event_id) > (f.layer, f.event_id) AND (g.path = f.path OR starts_with(g.path, f.path || '.') OR starts_with(f.path, g.path || '.')))
""")
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested configuration of every user, event over event and layer over layer: an object takes the place of a value and a value that of an object, other keys stay."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("layer"), "event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    inner = F.when(F.col("k") % 4 == 0, F.format_string('{"app":{"%s":%s}}', "t", F.col("k").cast("string"))).when(F.col("k") % 4 == 1, F.format_string('{"app":{"%s":{"deep":%s,"also":%s}}}', "t", F.col("k").cast("string"), F.col("event_id").cast("string")))
    inner = inner.when(F.col("k") % 4 == 2, F.format_string('{"%s":%s}', "t", F.col("k").cast("string"))).when(F.col("k") % 20 == 3, F.format_string('{"app":%s}', F.col("k").cast("string")))
    return deep_merged(flattened(e.select("user_id", "layer", "event_id", inner.alias("config"))), ["user_id"], ["layer", "event_id"])
