"""Resolution queries: methods through traits and parents, calls, names, views and owners of steps. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators.ranking import innermost
from graphweave.operators.resolve import resolve_methods, resolve_names
from graphweave.plans.flows import values
from graphweave.sources.driver_tables import table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Parts are classes (a part's parent has a fourth of its key, so part 0 is its own), suppliers traits, flag and status of a line a method's name.
_NAMES = ["AF", "AO", "NF", "NO", "RF", "RO"]
_TYPES = """
t AS (SELECT 'P' || p_partkey AS type, CASE WHEN p_size % 10 = 1 THEN 'missing' ELSE 'P' || (p_partkey // 4) END AS parent FROM part),
own AS (SELECT DISTINCT 'P' || l_partkey AS type, l_returnflag || l_linestatus AS name FROM lineitem WHERE l_quantity BETWEEN 44 AND 49),
offers AS (SELECT DISTINCT 'S' || l_suppkey AS trait, l_returnflag || l_linestatus AS name FROM lineitem WHERE l_quantity = 3),
uses AS (SELECT DISTINCT 'P' || l_partkey AS type, 'S' || l_suppkey AS trait FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10),
excl AS (SELECT DISTINCT 'P' || l_partkey AS type, l_returnflag || l_linestatus AS name, 'S' || l_suppkey AS trait FROM lineitem WHERE l_linenumber = 1 AND l_tax < 0.03),
al AS (SELECT 'P' || p_partkey AS type, 'AF' AS name, 'NO' AS meant FROM part WHERE p_size % 10 = 3),
comp AS (SELECT u.type, o.name, CASE WHEN count(DISTINCT u.trait) = 1 THEN min(u.trait) END AS owner FROM uses u JOIN offers o ON o.trait = u.trait WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x.type = u.type AND x.name = o.name AND x.trait = u.trait) GROUP BY u.type, o.name),
lev AS (SELECT type, name, 1 AS level, type AS owner, name AS original FROM own
  UNION ALL SELECT al.type, al.name, 2, comp.owner, CASE WHEN comp.owner IS NOT NULL THEN al.meant END FROM al LEFT JOIN comp ON comp.type = al.type AND comp.name = al.meant
  UNION ALL SELECT type, name, 3, owner, CASE WHEN owner IS NOT NULL THEN name END FROM comp),
loc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY level) AS rn FROM lev) WHERE rn = 1)
"""


@registered(f"""
WITH RECURSIVE {_TYPES}, names(name) AS (VALUES {values([(n,) for n in _NAMES])}),
up AS (SELECT t.type, names.name, t.type AS at, 0 AS steps FROM t, names
  UNION ALL SELECT up.type, up.name, t.parent, up.steps + 1 FROM up JOIN t ON t.type = up.at WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.type = up.at AND loc.name = up.name) AND up.steps < 20),
hit AS (SELECT up.type, up.name, up.steps, loc.owner, loc.original, loc.level FROM up JOIN loc ON loc.type = up.at AND loc.name = up.name)
SELECT t.type, names.name, hit.owner, hit.original, CAST(hit.steps AS INTEGER) AS steps,
       CASE WHEN hit.level IS NULL THEN 'unknown' WHEN hit.owner IS NULL THEN CASE WHEN hit.level = 3 THEN 'collision' ELSE 'unknown' END WHEN hit.steps > 0 THEN 'inherited' WHEN hit.level = 1 THEN 'own' WHEN hit.level = 2 THEN 'alias' ELSE 'trait' END AS outcome
FROM (t CROSS JOIN names) LEFT JOIN hit ON hit.type = t.type AND hit.name = names.name
""")
def method_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class runs for each name: own body, alias, the one composed trait, else the parent's; collisions, missing parents and cycles stay unresolved."""
    l = table(spark, sf_dir, "lineitem")
    part, of, name = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey"), F.concat("l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("type"), "p_size", F.concat(F.lit("P"), F.expr("p_partkey DIV 4")).alias("up"))
    classes = p.select("type", F.lit("class").alias("kind"), F.when(F.col("p_size") % 10 == 1, "missing").otherwise(F.col("up")).alias("parent"))
    offers = l.where("l_quantity = 3").select(of.alias("owner"), name.alias("name"), F.lit(False).alias("abstract"))
    traits = offers.select(F.col("owner").alias("type"), F.lit("trait").alias("kind"), F.lit(None).cast("string").alias("parent")).distinct()
    declared = l.where("l_quantity BETWEEN 44 AND 50").select(part.alias("owner"), name.alias("name"), (F.col("l_quantity") == 50).alias("abstract"))
    uses = l.where("l_linenumber = 1 AND l_quantity < 10").select(part.alias("type"), of.alias("trait"))
    exclusions = l.where("l_linenumber = 1 AND l_tax < 0.03").select(part.alias("type"), name.alias("name"), of.alias("trait")).distinct()
    aliases = p.where("p_size % 10 = 3").select("type", F.lit("AF").alias("name"), F.lit(None).cast("string").alias("trait"), F.lit("NO").alias("meant"))
    asked = p.select("type", F.explode(F.array(*map(F.lit, _NAMES))).alias("name"))
    return resolve_methods(classes.unionByName(traits), declared.unionByName(offers), uses, aliases, exclusions, asked)


#: Confidences in hundredths of a hundredth: the receiver itself, a typed property, one binding, several bindings and a name alone (both shared among N).
@registered("""
WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linestatus, l_returnflag FROM lineitem),
b AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey),
d AS (SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY l_returnflag, l_linestatus)
SELECT c.l_orderkey, c.l_partkey, c.l_suppkey, c.l_linestatus, c.l_returnflag,
       CASE WHEN s.s_suppkey = c.l_partkey % 50 THEN 'self' WHEN p_type = 'PROMO' THEN 'property' WHEN b.n IS NOT NULL AND p_size % 2 = 0 THEN 'binding' WHEN d.n IS NOT NULL THEN 'name' ELSE 'unresolved' END AS way,
       CAST(CASE WHEN s.s_suppkey = c.l_partkey % 50 THEN 10000 WHEN p_type = 'PROMO' THEN 9500 WHEN b.n IS NOT NULL AND p_size % 2 = 0 THEN CASE WHEN b.n = 1 THEN 9000 ELSE 6000 // b.n END WHEN d.n IS NOT NULL THEN 4000 // d.n END AS BIGINT) AS conf_bp
FROM c JOIN part ON p_partkey = c.l_partkey LEFT JOIN supplier s ON s.s_suppkey = c.l_suppkey LEFT JOIN b ON b.l_partkey = c.l_partkey LEFT JOIN d ON d.l_returnflag = c.l_returnflag AND d.l_linestatus = c.l_linestatus
""")
def member_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each member call is followed and how surely: the receiver itself, its declared type, what is bound to it, else every class that has the method by name.

    The candidates of a call count only by their number; they are not multiplied out.
    """
    l = table(spark, sf_dir, "lineitem")
    calls = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag").distinct()
    bound = l.where("l_returnflag <> 'N'").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("bound"))
    named = l.where("l_quantity = 50").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_partkey").alias("named"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("declared"))
    j = calls.join(parts, "l_partkey").join(bound, "l_partkey", "left").join(named, ["l_returnflag", "l_linestatus"], "left").join(known, "l_suppkey", "left")
    own = F.col("declared") & (F.col("l_suppkey") == F.col("l_partkey") % 50)
    typed, binding = F.col("p_type") == "PROMO", F.col("bound").isNotNull() & (F.col("p_size") % 2 == 0)
    way = F.when(own, "self").when(typed, "property").when(binding, "binding").when(F.col("named").isNotNull(), "name").otherwise("unresolved")
    conf = F.when(own, F.lit(10000)).when(typed, 9500).when(binding, F.when(F.col("bound") == 1, 9000).otherwise(F.expr("6000 DIV bound"))).when(F.col("named").isNotNull(), F.expr("4000 DIV named"))
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", way.alias("way"), conf.cast("long").alias("conf_bp"))


_ROOTS = [("Customer#0000000", "app/Near#"), ("Customer#000000", "app/Far#"), ("Customer#0000001", "lib/Hundred#")]


@registered(f"""
WITH roots(prefix, root) AS (VALUES {values(_ROOTS)}), n AS (SELECT DISTINCT c_nationkey AS file, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || chr(92) || c_name ELSE c_name END AS name FROM customer),
i AS (SELECT c_nationkey AS file, c_mktsegment AS alias, max('vendor' || chr(92) || lower(c_mktsegment)) AS meant FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2),
h AS (SELECT n.file, n.name, i.meant, substr(n.name, length(split_part(n.name, chr(92), 1)) + 1) AS rest FROM n LEFT JOIN i ON i.file = n.file AND i.alias = split_part(n.name, chr(92), 1)),
r AS (SELECT h.file, h.name, arg_max(root, length(prefix)) AS root, max(length(prefix)) AS n FROM h JOIN roots ON starts_with(h.name, prefix) WHERE h.meant IS NULL GROUP BY h.file, h.name)
SELECT h.file, h.name, CASE WHEN h.meant IS NOT NULL THEN h.meant || h.rest WHEN r.root IS NOT NULL THEN r.root || substr(h.name, r.n + 1) ELSE h.name END AS fqn, CASE WHEN h.meant IS NOT NULL THEN 'import' WHEN r.root IS NOT NULL THEN 'root' ELSE 'itself' END AS by
FROM h LEFT JOIN r ON r.file = h.file AND r.name = h.name
""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their file's imports first, then by the longest declared prefix, else as they stand."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("\\"), "c_name")).otherwise(F.col("c_name"))
    imports = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("alias"), F.concat(F.lit("vendor\\"), F.lower("c_mktsegment")).alias("meant"))
    return resolve_names(c.select(F.col("c_nationkey").alias("file"), name.alias("name")), imports, spark.createDataFrame(_ROOTS, "prefix string, root string"))


@registered("""
WITH call AS (SELECT l_orderkey, l_linenumber, 'views/' || replace(p_name, ' ', '/') || '.tpl' AS path, count(*) AS uses FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
tpl AS (SELECT 'views/' || replace(p_name, ' ', '/') || '.tpl' AS path, min(p_partkey) AS template FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_size < 9 GROUP BY 1)
SELECT call.path, tpl.template, CAST(sum(uses) AS BIGINT) AS calls, CAST(sum(CASE WHEN tpl.template IS NULL THEN uses ELSE 0 END) AS BIGINT) AS unmatched FROM call LEFT JOIN tpl ON tpl.path = call.path GROUP BY call.path, tpl.template
""")
def view_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View calls meet template files by the path their name stands for; calls without a template are counted, not dropped."""
    path = F.concat(F.lit("views/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".tpl")).alias("path")
    parts = table(spark, sf_dir, "part")
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses")).join(parts.select("p_partkey", path), "p_partkey")
    calls = calls.groupBy("path").agg(F.sum("uses").alias("calls"))
    templates = parts.where("p_type IN ('SMALL', 'LARGE') AND p_size < 9").select(path, "p_partkey").groupBy("path").agg(F.min("p_partkey").alias("template"))
    return calls.join(templates, "path", "left").select("path", "template", "calls", F.when(F.col("template").isNull(), F.col("calls")).otherwise(0).alias("unmatched"))


@registered("""
WITH s AS (SELECT DISTINCT user_id, event_id AS span_id, event_id % 97 AS start, event_id % 97 + event_id % 11 AS stop FROM events WHERE event_id % 3 = 0),
p AS (SELECT DISTINCT user_id, event_id, event_id % 131 AS line FROM events WHERE event_id % 3 <> 0),
r AS (SELECT p.user_id, p.event_id, p.line, s.span_id, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY s.stop - s.start, s.span_id) AS rn FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.start AND s.stop)
SELECT user_id, event_id, line, coalesce('span:' || span_id, 'file:' || user_id) AS node FROM r WHERE rn = 1
""")
def step_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node a step belongs to: the innermost span that covers its line, else its file."""
    e = table(spark, sf_dir, "events")
    spans = e.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("span_id"), F.expr("event_id % 97").alias("start"), F.expr("event_id % 97 + event_id % 11").alias("stop")).distinct()
    points = e.where("event_id % 3 <> 0").select("user_id", "event_id", F.expr("event_id % 131").alias("line")).distinct()
    found = innermost(points, spans, "user_id", "line")
    return found.select("user_id", "event_id", "line", F.coalesce(F.concat(F.lit("span:"), "span_id"), F.concat(F.lit("file:"), "user_id")).alias("node"))


@registered("""
WITH m AS (SELECT c_custkey, c_mktsegment || 'Policy' AS by_name FROM customer), d AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS policy FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey),
n AS (SELECT upper(substr(r_name, 1, 2)) AS head, min(r_name || 'Policy') AS policy FROM region GROUP BY 1)
SELECT m.c_custkey, coalesce(d.policy, n.policy) AS policy, CASE WHEN d.policy IS NOT NULL THEN 'declared' WHEN n.policy IS NOT NULL THEN 'name' ELSE 'none' END AS by FROM m LEFT JOIN d ON d.o_custkey = m.c_custkey LEFT JOIN n ON n.head = substr(m.by_name, 1, 2)
""")
def policy_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's policy: the last declared one, else the least of those its name suggests, else none."""
    m = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 2).alias("head"))
    declared = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("declared"))
    named = table(spark, sf_dir, "region").groupBy(F.upper(F.substring("r_name", 1, 2)).alias("head")).agg(F.min(F.concat("r_name", F.lit("Policy"))).alias("named"))
    j = m.join(declared, "c_custkey", "left").join(named, "head", "left")
    by = F.when(F.col("declared").isNotNull(), "declared").when(F.col("named").isNotNull(), "name").otherwise("none")
    return j.select("c_custkey", F.coalesce("declared", "named").alias("policy"), by.alias("by"))
