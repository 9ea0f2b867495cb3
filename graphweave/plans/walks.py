"""Queries over graphs with cycles: taint with its paths and the findings of it, strong components, dominators and dead code, surest paths. Each has its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.masks import ALL, mask
from graphweave.operators import graphs
from graphweave.operators.evidence import assemble, bare_ignores, path_text, ranked_paths, without_baseline
from graphweave.operators.incremental import scan
from graphweave.operators.scratch import shared_folder, written
from graphweave.operators.store import Store
from graphweave.operators.summaries import RESULT, RETURN, SINK, parameter_facts, stored_taint, summaries
from graphweave.operators.traverse import rebuilt, taint_walk
from graphweave.plans.flows import _PRIORITIES, _SEGMENTS, _SINKS, values
from graphweave.sources.driver_tables import part_calls, part_calls_sql, table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: The least tax of a call back in the graph that taint walks through, and parts that are roots of the call graph.
_BACK, _ROOTS = 0.07, "p_size <= 5"

_PATHS = f"""
WITH RECURSIVE seg(s, clears) AS (VALUES {values(_SEGMENTS)}), pri(p, clears) AS (VALUES {values(_PRIORITIES)}), sink(brand, rule, bit) AS (VALUES {values(_SINKS)}),
e AS (SELECT 'region' AS src_kind, CAST(n_regionkey AS BIGINT) AS src, 'nation' AS dst_kind, CAST(n_nationkey AS BIGINT) AS dst, 100 AS conf, 0 AS clears FROM nation
  UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey, 100, seg.clears FROM customer JOIN seg ON s = c_mktsegment
  UNION ALL SELECT 'customer', o_custkey, 'order', o_orderkey, 100, pri.clears FROM orders JOIN pri ON p = o_orderpriority
  UNION ALL SELECT 'order', l_orderkey, 'part', l_partkey, CAST(max(100 - round(100 * l_discount)) AS INTEGER), CASE l_returnflag WHEN 'A' THEN {mask('path')} ELSE 0 END FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag
  UNION ALL SELECT 'part', src, 'part', dst, conf, CASE dst % 7 WHEN 0 THEN {mask('html', 'sql')} ELSE 0 END FROM ({part_calls_sql(_BACK)})),
w AS (SELECT r_name AS root, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS key, 100 AS conf, {ALL} AS mask, [(-100, 'region', CAST(r_regionkey AS BIGINT), -{ALL})] AS back FROM region
  UNION ALL SELECT w.root, e.dst_kind, e.dst, least(w.conf, e.conf), w.mask & ~e.clears, list_prepend((-least(w.conf, e.conf), e.dst_kind, e.dst, -(w.mask & ~e.clears)), w.back)
  FROM w JOIN e ON e.src_kind = w.kind AND e.src = w.key WHERE w.mask & ~e.clears <> 0 AND len(list_filter(w.back, lambda s: s[2] = e.dst_kind AND s[3] = e.dst)) = 0),
h AS (SELECT w.root, sink.rule, w.key AS sink, w.conf, len(w.back) AS n, w.back FROM w JOIN part ON p_partkey = w.key JOIN sink ON brand = p_brand WHERE w.kind = 'part' AND w.mask & sink.bit <> 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, rule, sink ORDER BY conf DESC, n, back) AS rn FROM h) WHERE rn = 1),
tp AS (SELECT root, rule, sink, CAST(conf AS INTEGER) AS conf, CAST(n - 1 AS INTEGER) AS depth, array_to_string(list_transform(list_reverse(back), lambda s: s[2] || ':' || CAST(s[3] AS VARCHAR)), ' > ') AS path FROM best)
"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions declare nations, nations customers; customers handle orders, orders call parts, parts each other. Sanitizers stand on customers, orders and parts."""
    lit = lambda v: F.lit(v).cast("int")

    def edge(df: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, conf, clears) -> DataFrame:
        return df.select(F.lit(src_kind).alias("src_kind"), F.col(src).cast("long").alias("src"), F.lit(dst_kind).alias("dst_kind"), F.col(dst).cast("long").alias("dst"), conf.alias("conf"), clears.alias("clears"))

    segments, priorities = spark.createDataFrame(_SEGMENTS, "c_mktsegment string, clears int"), spark.createDataFrame(_PRIORITIES, "o_orderpriority string, clears int")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", (100 - F.round(100 * F.col("l_discount"))).cast("int").alias("conf"))
    if not table(spark, sf_dir, "lineitem").where("l_discount IS NULL").isEmpty():
        # Else several calls between the same two may stay several edges, of which the walk takes the surest; one without a confidence would pass for it.
        lines = lines.groupBy("l_orderkey", "l_partkey", "l_returnflag").agg(F.max("conf").alias("conf"))
    out = edge(table(spark, sf_dir, "nation"), "region", "n_regionkey", "nation", "n_nationkey", lit(100), lit(0))
    out = out.unionByName(edge(table(spark, sf_dir, "customer").join(F.broadcast(segments), "c_mktsegment"), "nation", "c_nationkey", "customer", "c_custkey", lit(100), F.col("clears")))
    out = out.unionByName(edge(table(spark, sf_dir, "orders").join(F.broadcast(priorities), "o_orderpriority"), "customer", "o_custkey", "order", "o_orderkey", lit(100), F.col("clears")))
    out = out.unionByName(edge(lines, "order", "l_orderkey", "part", "l_partkey", F.col("conf"), F.when(F.col("l_returnflag") == "A", mask("path")).otherwise(0)))
    return out.unionByName(edge(part_calls(spark, sf_dir, _BACK), "part", "src", "part", "dst", F.col("conf"), F.when(F.expr("dst % 7 = 0"), mask("html", "sql")).otherwise(0)))


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``root, rule, sink, conf, depth, steps``: per root, rule and sink the surest, then shortest path of the walk that still carries the rule's kind."""
    roots = table(spark, sf_dir, "region").select(F.col("r_name").alias("root"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("key"), F.lit(ALL).alias("mask"))
    states = taint_walk(_flow(spark, sf_dir), roots, trace=True, winners=True)
    sinks = spark.createDataFrame(_SINKS, "p_brand string, rule string, bit int")
    parts = table(spark, sf_dir, "part").join(F.broadcast(sinks), "p_brand").select(F.col("p_partkey").alias("key"), "rule", "bit")
    hits = states.where("kind = 'part'").join(parts, "key").where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    first = F.min(F.struct((-F.col("conf")).alias("doubt"), "depth", (-F.col("mask")).alias("less"), "prev")).alias("f")
    best = hits.groupBy("key", "kind", "root", "rule").agg(first)
    best = best.select("root", "kind", "key", (-F.col("f.less")).alias("mask"), (-F.col("f.doubt")).alias("conf"), F.col("f.depth").alias("depth"), F.col("f.prev").alias("prev"), "rule")
    return rebuilt(states, best).select("root", "rule", F.col("key").alias("sink"), "conf", "depth", "steps")


@registered(_PATHS + "SELECT * FROM tp")
def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path by which taint reaches each sink, out of a walk over a graph with cycles: of each root, rule and sink the surest, then shortest, told apart from its end backward."""
    path = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["kind"], s["key"].cast("string"))), " > ")
    return _winners(spark, sf_dir).select("root", "rule", "sink", "conf", "depth", path.alias("path"))


_RANKS = [(rule, "taint", 4 if rule in ("sql", "shell", "code") else 3) for rule in sorted({s[1] for s in _SINKS})]
#: Suppressions of a configuration: rule, glob of files, last day; and the day of the scan.
_GLOBS = [("sql", "app/*ring", None), ("html", "app/*bolt", "2024-05-31"), ("shell", "app/*wheel", "2024-06-01"), ("url", "app/?e*", None), ("nothing", "*", None)]
_DAY, _BARE = "2024-06-01", "bare-ignore"


@registered(_PATHS + f""",
r(rule, kind, rank) AS (VALUES {values(_RANKS)}), g(rule, pattern, expires) AS (VALUES {values(_GLOBS)}),
p AS (SELECT tp.*, CASE WHEN p_type = 'LARGE' THEN 'vendor/' ELSE 'app/' END || p_name AS file, string_split(path, ' > ') AS s, CASE r_regionkey % 3 WHEN 0 THEN 'unauthenticated' WHEN 1 THEN 'http' ELSE 'console' END AS entry
  FROM tp JOIN part ON p_partkey = sink JOIN region ON r_name = root),
t AS (SELECT *, 'entry:' || s[1] || array_to_string(list_transform(s[2:-2], lambda x: ' > call:' || x), '') || ' > sink:' || file || ':' || CAST(sink AS VARCHAR) AS text,
  'entry:' || s[1] || array_to_string(list_transform(s[2:-2], lambda x: ' > call:' || x), '') || ' > sink:' || s[-1] AS snippets FROM p),
a AS (SELECT rule, file, sink AS line, bool_or(entry <> 'console') AS http, bool_or(entry = 'unauthenticated') AS open, count(*) - 1 AS alternatives FROM t GROUP BY rule, file, sink),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, file, sink ORDER BY conf DESC, depth, text) AS rn FROM t) WHERE rn = 1),
x AS (SELECT substr(sha1(concat_ws('|', a.rule, a.file, CAST(a.line AS VARCHAR), b.text)), 1, 16) AS id, substr(sha1(concat_ws('|', a.rule, a.file, b.snippets)), 1, 16) AS fingerprint, a.rule, a.file, a.line, b.conf AS confidence, a.alternatives, b.text AS path, b.conf < 70 AS needs_review,
  greatest(0, least(4, r.rank + CASE WHEN a.open THEN 1 WHEN NOT a.http THEN -1 ELSE 0 END)) AS raised FROM a JOIN b ON b.rule = a.rule AND b.file = a.file AND b.sink = a.line JOIN r ON r.rule = a.rule WHERE a.file NOT LIKE '%vendor/%'),
y AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 13 AND 'app/' || p_name = x.file AND p_partkey + 1 = x.line)
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.rule = x.rule AND x.file GLOB g.pattern AND (g.expires IS NULL OR g.expires >= '{_DAY}')))
SELECT id, fingerprint, rule, file, line, list_extract(['info', 'low', 'medium', 'high', 'critical'], CAST(greatest(0, raised - CASE WHEN needs_review THEN 1 ELSE 0 END) AS INTEGER) + 1) AS severity, needs_review, confidence, alternatives, path
FROM y WHERE fingerprint NOT IN (SELECT fingerprint FROM y JOIN part ON p_partkey = y.line WHERE p_size % 9 = 0)
UNION ALL SELECT DISTINCT substr(sha1(concat_ws('|', '{_BARE}', 'app/' || p_name, CAST(p_partkey AS VARCHAR), 'entry:app/' || p_name || ':' || CAST(p_partkey AS VARCHAR))), 1, 16), substr(sha1(concat_ws('|', '{_BARE}', 'app/' || p_name, 'entry:ignore ' || p_brand)), 1, 16),
  '{_BARE}', 'app/' || p_name, p_partkey, 'low', false, 100, 0, 'entry:app/' || p_name || ':' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 17
""")
def taint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the walked paths in their whole order: bare ignores stand beside them; entry points move severities, the surest path is primary, vendor sinks go, unsure ones are for review,
    then next-line suppressions, globs with their expiry, and the baseline of a scan before, read back from the store."""
    found = _winners(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sink"), F.concat(F.when(F.col("p_type") == "LARGE", "vendor/").otherwise("app/"), "p_name").alias("file"), "p_name", "p_size", "p_brand")
    entries = table(spark, sf_dir, "region").select(F.col("r_name").alias("root"), F.when(F.expr("r_regionkey % 3 = 0"), "unauthenticated").when(F.expr("r_regionkey % 3 = 1"), "http").otherwise("console").alias("entry"))
    rows = found.join(parts.select("sink", "file"), "sink").join(F.broadcast(entries), "root")
    n = F.size("steps")

    def step(s, i):
        role = F.when(i == 0, "entry").when(i == n - 1, "sink").otherwise("call")
        return F.struct(role.alias("role"), F.when(i == n - 1, F.col("file")).otherwise(s["kind"]).alias("file"), s["key"].alias("line"), F.concat_ws(":", s["kind"], s["key"].cast("string")).alias("snippet"),
                        F.when(i == 0, F.col("entry")).alias("entry"), s["conf"].alias("confidence"))

    ranked = ranked_paths(rows.select("rule", "file", F.col("sink").alias("line"), F.transform("steps", step).alias("steps")))
    rules = spark.createDataFrame(_RANKS, "rule string, kind string, rank int")
    marks = parts.where("p_size = 13").crossJoin(F.broadcast(rules.select("rule"))).select(F.concat(F.lit("app/"), "p_name").alias("file"), "rule", F.col("sink").alias("line"))
    globs = spark.createDataFrame(_GLOBS, "rule string, pattern string, expires string").withColumn("expires", F.col("expires").cast("date"))
    # The scan before, whose paths are the same, stored what is now the baseline.
    store = Store(spark, f"{shared_folder(spark)}/graphweave-store-{uuid.uuid4().hex}")
    before = written(assemble(ranked, rules, marks, None, unsure_under=70, globs=globs, as_of=F.lit(_DAY).cast("date")), "findings")
    store.commit(baseline=before.join(parts.select(F.col("sink").alias("line"), "p_size"), "line").where("p_size % 9 = 0").select("fingerprint"))
    now = without_baseline(before, store.read("baseline"))
    bare = bare_ignores(parts.where("p_size = 17").select(F.concat(F.lit("app/"), "p_name").alias("file"), F.col("sink").alias("line"), F.concat(F.lit("ignore "), "p_brand").alias("snippet")), _BARE, 1)
    columns = ["id", "fingerprint", "rule", "file", "line", "severity", "needs_review", "confidence", "alternatives", path_text(F.col("steps")).alias("path")]
    return now.select(*columns).unionByName(bare.select(*columns)).orderBy("file", "line", "rule")


@registered(f"""
WITH RECURSIVE e AS MATERIALIZED ({part_calls_sql()}), c AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
s AS (SELECT n.node, greatest(n.node, coalesce(max(a.dst), n.node)) AS component FROM n LEFT JOIN (SELECT a.src, a.dst FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src) a ON a.src = n.node GROUP BY n.node),
d AS MATERIALIZED (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.component <> b.component),
l AS (SELECT DISTINCT component, 0 AS level FROM s UNION SELECT d.dst, l.level + 1 FROM l JOIN d ON d.src = l.component)
SELECT s.node, s.component, count(*) OVER (PARTITION BY s.component) AS size, x.level FROM s JOIN (SELECT component, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY component) x ON x.component = s.component
""")
def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that call each other in circles: the strong component of every part, its size, and its level in the condensed graph (0: nothing calls it)."""
    calls = written(part_calls(spark, sf_dir).select("src", "dst"), "calls")
    found = written(graphs.strong_components(calls), "components")
    level = graphs.levels(graphs.condensed(calls, found), found.select(F.col("component").alias("node"))).withColumnRenamed("node", "component")
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(size, "component").join(level, "component").select("node", "component", "size", "level")


@registered(f"""
WITH RECURSIVE e AS MATERIALIZED ({part_calls_sql()}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS MATERIALIZED (SELECT p_partkey AS node FROM part JOIN n ON node = p_partkey WHERE {_ROOTS}),
live AS MATERIALIZED (SELECT node FROM r UNION SELECT e.dst FROM live JOIN e ON e.src = live.node),
w AS MATERIALIZED (SELECT d.node AS without, r.node FROM live d, r WHERE d.node <> r.node UNION SELECT w.without, e.dst FROM w JOIN e ON e.src = w.node WHERE e.dst <> w.without),
dom AS (SELECT l.node, d.node AS top FROM live l, live d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.without = d.node AND w.node = l.node))
SELECT n.node, l.node IS NOT NULL AS live, d.dominators FROM n LEFT JOIN live l ON l.node = n.node LEFT JOIN (SELECT node, string_agg(CAST(top AS VARCHAR), ',' ORDER BY top) AS dominators FROM dom GROUP BY node) d ON d.node = n.node
""")
def call_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every part in the call graph the parts that all ways from the roots to it pass; parts that no root reaches are dead code."""
    calls = written(part_calls(spark, sf_dir).select("src", "dst"), "calls")
    nodes = calls.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = nodes.join(table(spark, sf_dir, "part").where(_ROOTS).select(F.col("p_partkey").alias("node")), "node", "left_semi")
    found = graphs.dominators(calls, roots)
    joined = F.array_join(F.transform("dominators", lambda d: d.cast("string")), ",")
    return nodes.join(found, "node", "left").select("node", F.col("dominators").isNotNull().alias("live"), joined.alias("dominators"))


@registered(f"""
WITH RECURSIVE e AS MATERIALIZED ({part_calls_sql(_BACK)}), r AS (SELECT p_partkey AS node FROM part WHERE {_ROOTS}),
w AS (SELECT node, 100 AS conf, [node] AS way FROM r UNION ALL SELECT e.dst, least(w.conf, e.conf), list_append(w.way, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.way, e.dst)),
t AS (SELECT node, conf, CAST(len(way) - 1 AS INTEGER) AS length, array_to_string(way, ' > ') AS path FROM w)
SELECT node, CAST(rank AS INTEGER) AS rank, CAST(conf AS INTEGER) AS conf, length, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY conf DESC, length, path) AS rank FROM t) WHERE rank <= 3
""")
def surest_call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three surest simple paths from the roots of the call graph to every part: by least confidence, then length, then text."""
    roots = table(spark, sf_dir, "part").where(_ROOTS).select(F.col("p_partkey").alias("node"))
    return graphs.surest_paths(part_calls(spark, sf_dir, _BACK), roots, 3)


_BRANDS = f"brand(brand, rule, bit) AS (VALUES {values(_SINKS)})"


@registered(f"""
WITH RECURSIVE {_BRANDS}, p AS MATERIALIZED (SELECT p_partkey AS node, p_size, bit FROM part JOIN brand ON brand = p_brand), bits AS (SELECT 1 << CAST(unnest(range(0, 12)) AS INTEGER) AS b),
c AS MATERIALIZED (SELECT src, dst, CASE WHEN dst % 7 = 0 THEN {ALL & ~mask('html', 'sql')} ELSE {ALL} END AS first_keeps, CASE WHEN src % 3 = 0 THEN {ALL & ~mask('shell')} ELSE {ALL} END AS keeps FROM ({part_calls_sql()})),
r AS (SELECT node, 0 AS param, b FROM p, bits WHERE p_size % 2 = 0
  UNION SELECT c.src, (r.param + c.dst) % 2, r.b FROM r JOIN c ON c.dst = r.node WHERE c.keeps & r.b <> 0 AND ((r.param + c.dst) % 2 = 1 OR c.first_keeps & r.b <> 0)),
s AS (SELECT node, p_size % 4 AS param, bit AS b FROM p WHERE p_size % 4 < 2
  UNION SELECT c.src, (s.param + c.dst) % 2, s.b FROM s JOIN c ON c.dst = s.node WHERE (s.param + c.dst) % 2 = 1 OR c.first_keeps & s.b <> 0),
m AS (SELECT node, 'r' AS what, param, b FROM r UNION ALL SELECT node, 's', param, b FROM s),
g AS (SELECT node, bit_or(CASE WHEN what = 'r' AND param = 0 THEN b ELSE 0 END) AS r0, bit_or(CASE WHEN what = 'r' AND param = 1 THEN b ELSE 0 END) AS r1,
  bit_or(CASE WHEN what = 's' AND param = 0 THEN b ELSE 0 END) AS s0, bit_or(CASE WHEN what = 's' AND param = 1 THEN b ELSE 0 END) AS s1 FROM m GROUP BY node)
SELECT p_partkey AS symbol, CAST(coalesce(r0, 0) AS INTEGER) AS return_0, CAST(coalesce(r1, 0) AS INTEGER) AS return_1, CAST(coalesce(s0, 0) AS INTEGER) AS sink_0, CAST(coalesce(s1, 0) AS INTEGER) AS sink_1 FROM part LEFT JOIN g ON node = p_partkey
""")
def parameter_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every part does with its two parameters: the kinds that come back, and those that reach sinks in it or in what it calls, also where parts call each other in circles.

    A call passes both parameters on, exchanged where the callee's number is odd; the first loses kinds on the way to some callees, results lose one on the way back from others.
    """
    p = table(spark, sf_dir, "part").join(F.broadcast(spark.createDataFrame(_SINKS, "p_brand string, rule string, bit int")), "p_brand").select(F.col("p_partkey").alias("symbol"), "p_size", "bit")
    c = written(part_calls(spark, sf_dir).select(F.col("src").alias("symbol"), F.col("dst").cast("string").alias("site"), F.col("dst").alias("callee")), "calls")

    def flow(df: DataFrame, src_site, src_pos, dst_site, dst_pos, keeps) -> DataFrame:
        return df.select("symbol", src_site.alias("src_site"), src_pos.cast("int").alias("src_pos"), dst_site.alias("dst_site"), dst_pos.cast("int").alias("dst_pos"), keeps.cast("int").alias("keeps"))

    own, first = F.lit(""), F.when(F.expr("callee % 7 = 0"), ALL & ~mask("html", "sql")).otherwise(ALL)
    flows = flow(p.where("p_size % 2 = 0"), own, F.lit(0), own, F.lit(RETURN), F.lit(ALL))
    flows = flows.unionByName(flow(p.where("p_size % 4 < 2"), own, F.col("p_size") % 4, own, F.lit(SINK), F.col("bit")))
    flows = flows.unionByName(flow(c, own, F.lit(0), F.col("site"), F.col("callee") % 2, first)).unionByName(flow(c, own, F.lit(1), F.col("site"), (F.col("callee") + 1) % 2, F.lit(ALL)))
    flows = flows.unionByName(flow(c, F.col("site"), F.lit(RESULT), own, F.lit(RETURN), F.when(F.expr("symbol % 3 = 0"), ALL & ~mask("shell")).otherwise(ALL)))
    found = summaries(parameter_facts(flows, c))
    at = lambda column, i: F.coalesce(F.get(column, i), F.lit(0))
    rows = p.select("symbol").join(found, "symbol", "left")
    return rows.select("symbol", at("returns", 0).alias("return_0"), at("returns", 1).alias("return_1"), at("sinks", 0).alias("sink_0"), at("sinks", 1).alias("sink_1"))


@registered(f"""
WITH RECURSIVE seg(s, clears) AS (VALUES {values(_SEGMENTS)}), pri(p, clears) AS (VALUES {values(_PRIORITIES)}), bits AS (SELECT 1 << CAST(unnest(range(0, 12)) AS INTEGER) AS b),
e AS MATERIALIZED (SELECT 'customer' AS src_kind, CAST(o_custkey AS BIGINT) AS src, 'order' AS dst_kind, CAST(o_orderkey AS BIGINT) AS dst, pri.clears FROM orders JOIN pri ON p = o_orderpriority
  UNION ALL SELECT DISTINCT 'order', l_orderkey, 'part', l_partkey, CASE l_returnflag WHEN 'A' THEN {mask('path')} ELSE 0 END FROM lineitem),
io AS MATERIALIZED (SELECT 'part' AS src_kind, CAST(p_partkey AS BIGINT) AS src, 'column' AS dst_kind, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS dst, {ALL & mask('sql', 'shell', 'url', 'log', 'code')} AS keeps FROM part WHERE p_size % 10 = 3
  UNION ALL SELECT 'column', CAST(c_custkey % 40 AS BIGINT), 'customer', c_custkey, {ALL} FROM customer WHERE c_custkey % 40 BETWEEN 11 AND 25 AND c_custkey % 3 = 0),
start AS (SELECT 'customer' AS kind, CAST(c_custkey AS BIGINT) AS key, b FROM customer JOIN seg ON s = c_mktsegment, bits WHERE c_custkey % 50 = 7 AND ({ALL} & ~clears) & b <> 0),
d AS (SELECT * FROM start UNION SELECT e.dst_kind, e.dst, d.b FROM d JOIN e ON e.src_kind = d.kind AND e.src = d.key WHERE e.clears & d.b = 0),
w AS (SELECT * FROM start UNION SELECT x.dst_kind, x.dst, w.b FROM w JOIN (SELECT src_kind, src, dst_kind, dst, {ALL} & ~clears AS keeps FROM e UNION ALL SELECT * FROM io) x ON x.src_kind = w.kind AND x.src = w.key WHERE x.keeps & w.b <> 0)
SELECT w.kind, w.key, CAST(coalesce(any_value(g.direct), 0) AS INTEGER) AS direct, CAST(bit_or(w.b) AS INTEGER) AS mask FROM w LEFT JOIN (SELECT kind, key, bit_or(b) AS direct FROM d GROUP BY kind, key) g ON g.kind = w.kind AND g.key = w.key
WHERE w.kind <> 'column' GROUP BY w.kind, w.key
""")
def second_order_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint that some customers bring to orders and parts, and what comes back of it: some parts write to the column of their brand, which other customers read. Kinds by the first walk, and by all."""
    lit = lambda v: F.lit(v).cast("int")
    segments, priorities = spark.createDataFrame(_SEGMENTS, "c_mktsegment string, clears int"), spark.createDataFrame(_PRIORITIES, "o_orderpriority string, clears int")
    names = ["src_kind", "src", "dst_kind", "dst", "conf", "clears"]
    o = table(spark, sf_dir, "orders").join(F.broadcast(priorities), "o_orderpriority").select(F.lit("customer"), F.col("o_custkey").cast("long"), F.lit("order"), F.col("o_orderkey").cast("long"), lit(100), "clears").toDF(*names)
    calls = table(spark, sf_dir, "lineitem").select(F.lit("order"), "l_orderkey", F.lit("part"), "l_partkey", lit(100), F.when(F.col("l_returnflag") == "A", mask("path")).otherwise(0)).toDF(*names).distinct()
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    sources = customers.where("c_custkey % 50 = 7").join(F.broadcast(segments), "c_mktsegment")
    sources = sources.select(F.lit("input").alias("root"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("key"), F.lit(ALL).bitwiseAND(F.bitwise_not("clears")).alias("mask"))
    writes = parts.where("p_size % 10 = 3").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("long").alias("key"), F.regexp_replace("p_brand", "Brand#", "").alias("column"), F.lit(mask("sql", "shell", "url", "log", "code")).alias("keeps"))
    reads = customers.where("c_custkey % 40 BETWEEN 11 AND 25 AND c_custkey % 3 = 0").select(F.expr("CAST(c_custkey % 40 AS STRING)").alias("column"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("key"))
    states = stored_taint(o.unionByName(calls), sources, writes, reads)
    first = F.bit_or(F.when(F.col("generation") == 1, F.col("mask")).otherwise(0))
    return states.groupBy("kind", "key").agg(first.alias("direct"), F.bit_or("mask").alias("mask"))


@registered(f"""
WITH RECURSIVE {_BRANDS}, e AS MATERIALIZED ({part_calls_sql()}), changed AS (SELECT p_partkey AS node FROM part WHERE substr(sha1(p_name || CAST(p_partkey AS VARCHAR)), 1, 1) = '0'),
t AS (SELECT node FROM changed UNION SELECT e.src FROM t JOIN e ON e.dst = t.node),
m AS (SELECT p_partkey AS node, bit AS b FROM part JOIN brand ON brand = p_brand UNION SELECT e.src, m.b FROM m JOIN e ON e.dst = m.node)
SELECT m.node, CAST(bit_or(m.b) AS INTEGER) AS mask, any_value(t.node) IS NOT NULL AS touched FROM m LEFT JOIN t ON t.node = m.node GROUP BY m.node
""")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of sinks that every part reaches, by a second scan over the stored first one: only parts whose digest changed, and all that reach them, are worked out again.

    At the first scan one part in sixteen had another kind and lacked its calls to even parts. Parts without a known brand, and called ones that have no row, have no kind of their own but pass on
    what they reach. A part without a key is called by none, so it has only its own kind.
    """
    kinds = F.broadcast(spark.createDataFrame(_SINKS, "p_brand string, rule string, bit int"))
    changed = F.substring(F.sha1(F.concat("p_name", F.col("p_partkey").cast("string"))), 1, 1) == "0"
    rows = table(spark, sf_dir, "part").join(kinds, "p_brand", "left").select(F.col("p_partkey").alias("node"), F.coalesce("bit", F.lit(0)).alias("bit"), F.coalesce(changed, F.lit(False)).alias("changed"))
    calls = written(part_calls(spark, sf_dir).select("src", "dst"), "calls")
    ends = calls.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(0).alias("bit"), F.lit(False).alias("changed"))
    every = written(rows.unionByName(ends).groupBy("node").agg(F.bit_or("bit").alias("bit"), F.max("changed").alias("changed")), "parts")
    parts = every.where("node IS NOT NULL")
    flags = parts.select(F.col("node").alias("src"), "changed")
    first = calls.join(flags, "src").where("NOT changed OR dst % 2 = 1").select("src", "dst")
    another = F.when(F.col("bit") == 1, 2).otherwise(1)
    store = Store(spark, f"{shared_folder(spark)}/graphweave-store-{uuid.uuid4().hex}")
    for edges, mask_ in ((first, F.when(F.col("changed"), another).otherwise(F.col("bit"))), (calls, F.col("bit"))):
        body = edges.groupBy(F.col("src").alias("node")).agg(F.bit_xor(F.xxhash64("dst")).alias("calls"))
        symbols = parts.join(body, "node", "left").select("node", F.sha1(F.concat_ws("|", mask_.cast("string"), F.col("calls").cast("string"))).alias("digest"), mask_.alias("mask"))
        found = scan(store, symbols, edges)
    unkeyed = every.where("node IS NULL").select("node", F.col("bit").alias("mask"), F.lit(False).alias("touched"))
    return found.select("node", "mask", "touched").unionByName(unkeyed).where("mask <> 0")
