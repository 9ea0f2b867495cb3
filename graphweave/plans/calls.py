"""Call, template, expression and report queries. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.calls import argument, bound_class, clears, returned_taint, with_markers
from graphweave.functions.identity import node_id
from graphweave.functions.masks import ALL, mask
from graphweave.operators.ranking import innermost
from graphweave.operators.resolve import resolve_properties
from graphweave.operators.scratch import numbered
from graphweave.operators.traverse import fold_tree, taint_walk
from graphweave.plans.controls import _ROUTES, _routes
from graphweave.plans.flows import values
from graphweave.plans.resolution import _TYPES
from graphweave.sources.driver_tables import table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@registered("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE string_split(p_name, ' ')[2] END AS argument, p_size % 2 = 0 AS named, p_type = 'LARGE' AS exempt FROM part
""")
def sink_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argument that reaches a sink's parameter: the one named like it, else the one at its place among those without a name; a list is no shell string."""
    nothing = F.lit(None).cast("string")
    one = lambda name, value, kind: F.struct(name.alias("name"), value.alias("value"), kind.alias("kind"))
    kind = F.when(F.col("p_type") == "LARGE", "list").otherwise("text")
    words = F.transform(F.split("p_name", " "), lambda w: one(nothing, w, kind))
    own = F.when(F.col("p_size") % 2 == 0, F.array(one(F.lit("command"), F.col("p_brand"), kind)))
    # A named argument may stand before those that go by place.
    args = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.coalesce(own, F.array().cast("array<struct<name:string,value:string,kind:string>>")), words).alias("args"))
    pick = argument(F.col("args"), "command", 1)
    return args.select("p_partkey", pick["value"].alias("argument"), pick["name"].isNotNull().alias("named"), (pick["kind"] == "list").alias("exempt"))


@registered(r"""
WITH c AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS chain FROM pages)
SELECT page_id, len(chain) AS links, (list_contains(chain, 'en') OR list_contains(chain, 'fr') OR list_contains(chain, 'es')) AND NOT list_contains(chain, 'es') AS html FROM c
""")
def response_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a chain of receivers answers with HTML: some link makes a response and none makes it JSON."""
    c = table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("url", "^https?://", ""), "/").alias("chain"))
    makes = F.exists("chain", lambda x: x.isin("en", "fr", "es"))
    return c.select("page_id", F.size("chain").alias("links"), (makes & ~F.exists("chain", lambda x: x == "es")).alias("html"))


@registered("""
SELECT e.event_id, e.event_type = 'signup' OR EXISTS (SELECT 1 FROM events v WHERE v.event_id % 10 = 0 AND v.user_id = e.user_id AND v.event_type = e.event_type) AS request FROM events e WHERE e.event_id % 10 <> 0
""")
def request_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a receiver is the request: a variable its method declares as one, or the call that returns it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    declared = e.where("event_id % 10 = 0").select("user_id", "event_type").distinct().withColumn("declared", F.lit(True))
    j = e.where("event_id % 10 <> 0").join(declared, ["user_id", "event_type"], "left")
    return j.select("event_id", ((F.col("event_type") == "signup") | F.coalesce("declared", F.lit(False))).alias("request"))


@registered("""
WITH c AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 10 = 1 THEN -1 ELSE p_partkey // 4 END AS up FROM part)
SELECT substr(sha1(concat_ws('|', '1', 'part', CAST(c.p_partkey AS VARCHAR), '')), 1, 16) AS src_id, CASE WHEN p.p_partkey IS NOT NULL THEN substr(sha1(concat_ws('|', '1', 'part', CAST(c.up AS VARCHAR), '')), 1, 16) END AS dst_id,
       CASE WHEN p.p_partkey IS NULL THEN c.up END AS dangling FROM c LEFT JOIN part p ON p.p_partkey = c.up WHERE c.up IS NOT NULL
""")
def extends_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge to the parent that is declared; a parent that is not stays as an attribute."""
    p = table(spark, sf_dir, "part")
    up = F.when(F.col("p_size") % 9 == 0, None).when(F.col("p_size") % 10 == 1, F.lit(-1).cast("long")).otherwise(F.expr("p_partkey DIV 4"))
    c = p.select("p_partkey", up.alias("up")).where("up IS NOT NULL")
    j = c.join(p.select(F.col("p_partkey").alias("known")), F.col("up") == F.col("known"), "left")
    return j.select(node_id(F.lit("part"), F.col("p_partkey")).alias("src_id"), F.when(F.col("known").isNotNull(), node_id(F.lit("part"), F.col("up"))).alias("dst_id"), F.when(F.col("known").isNull(), F.col("up")).alias("dangling"))


_KNOWN = ["auth", "auth.session", "signed", "throttle", "can", "guest"]


@registered(_ROUTES + f""", w AS (SELECT o_orderkey, unnest(string_split(middleware, ',')) AS m FROM r), k(name) AS (VALUES {values([(n,) for n in _KNOWN])}),
s AS (SELECT DISTINCT w.o_orderkey, split_part(m, ':', 1) AS name FROM w)
SELECT s.o_orderkey, string_agg(k.name, ',' ORDER BY k.name) AS protected_by, count(*) - count(k.name) AS unresolved FROM s LEFT JOIN k ON k.name = s.name GROUP BY s.o_orderkey
""")
def protected_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middleware nodes that protect a route, each once, and how many of its names stand for no node."""
    known = spark.createDataFrame([(n, n) for n in _KNOWN], "name string, node string")
    s = _routes(spark, sf_dir).select("o_orderkey", F.explode("middleware").alias("m")).select("o_orderkey", F.substring_index("m", ":", 1).alias("name")).distinct()
    g = s.join(F.broadcast(known), "name", "left").groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("p"), (F.count("*") - F.count("node")).alias("unresolved"))
    return g.select("o_orderkey", F.nullif("p", F.lit("")).alias("protected_by"), "unresolved")


@registered(f"""
WITH RECURSIVE {_TYPES}, props AS (SELECT 'P' || p_partkey AS type, p_brand AS declared FROM part WHERE p_size % 7 = 0), tprops AS (SELECT 'S' || s_suppkey AS trait, s_name AS declared FROM supplier WHERE s_suppkey % 3 = 0),
ord AS (SELECT DISTINCT 'P' || l_partkey AS type, 'S' || l_suppkey AS trait, l_suppkey AS ord FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10),
tr AS (SELECT o.type, arg_min(tp.declared, o.ord) AS declared, arg_min(o.trait, o.ord) AS owner FROM ord o JOIN tprops tp ON tp.trait = o.trait GROUP BY o.type),
d AS (SELECT type, declared, type AS owner FROM props UNION ALL SELECT * FROM tr WHERE type NOT IN (SELECT type FROM props)),
up AS (SELECT type, type AS at, 0 AS steps FROM t UNION ALL SELECT up.type, t.parent, up.steps + 1 FROM up JOIN t ON t.type = up.at WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.type = up.at) AND up.steps < 20),
hit AS (SELECT up.type, up.steps, d.declared, d.owner FROM up JOIN d ON d.type = up.at)
SELECT t.type, 'repo' AS name, hit.declared, hit.owner, CAST(hit.steps AS INTEGER) AS steps FROM t LEFT JOIN hit ON hit.type = t.type
""")
def property_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared type of a property: the class's own, then its traits in order, then its parent's."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("P"), "p_partkey")
    types = p.select(name.alias("type"), F.lit("class").alias("kind"), F.when(F.col("p_size") % 10 == 1, "missing").otherwise(F.concat(F.lit("P"), F.expr("p_partkey DIV 4"))).alias("parent"))
    own = p.where("p_size % 7 = 0").select(name.alias("owner"), F.lit("repo").alias("name"), F.col("p_brand").alias("declared"))
    of_traits = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("owner"), F.lit("repo").alias("name"), F.col("s_name").alias("declared"))
    uses = l.where("l_linenumber = 1 AND l_quantity < 10").select(F.concat(F.lit("P"), "l_partkey").alias("type"), F.concat(F.lit("S"), "l_suppkey").alias("trait"), F.col("l_suppkey").alias("ord"))
    return resolve_properties(types, own.unionByName(of_traits), uses, types.select("type", F.lit("repo").alias("name")))


@registered("""
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS lexical, l_suppkey AS receiver, l_returnflag || l_linestatus AS scope FROM lineitem)
SELECT s.l_orderkey, s.l_linenumber, s.lexical, s.receiver, s.scope,
       CASE WHEN scope IN ('AF', 'AO') THEN CASE WHEN p_type = 'SMALL' THEN 'R' || receiver ELSE 'L' || lexical END WHEN scope = 'RF' THEN 'R' || receiver WHEN scope = 'RO' THEN CASE WHEN p_size % 9 <> 0 THEN 'L' || (lexical // 4) END ELSE 'N' || p_brand END AS bound
FROM s LEFT JOIN part ON p_partkey = s.lexical
""")
def receiver_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a static scope binds to: ``self`` the lexical class (in a trait the class that composes it), ``static`` the runtime class, ``parent`` the lexical class's parent, else the name."""
    scope = F.concat("l_returnflag", "l_linestatus")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("lexical"), F.col("l_suppkey").alias("receiver"), scope.alias("scope")).distinct()
    j = s.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lexical"), "p_type", "p_size", "p_brand"), "lexical", "left")
    runtime, own, up = F.concat(F.lit("R"), "receiver"), F.concat(F.lit("L"), "lexical"), F.when(F.col("p_size") % 9 != 0, F.concat(F.lit("L"), F.expr("lexical DIV 4")))
    # Flags stand for scopes.
    said = F.when(F.col("scope").isin("AF", "AO"), "self").when(F.col("scope") == "RF", "static").when(F.col("scope") == "RO", "parent").otherwise(F.concat(F.lit("N"), "p_brand"))
    bound = bound_class(said, own, runtime, up, F.coalesce(F.col("p_type") == "SMALL", F.lit(False)))
    return j.select("l_orderkey", "l_linenumber", "lexical", "receiver", "scope", bound.alias("bound"))


@registered(f"""
WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, l_linestatus, l_quantity >= 25 AS carries FROM lineitem)
SELECT o_orderstatus AS caller, outcome, count(*) AS attempts FROM (SELECT o_orderstatus, CASE WHEN p_size % 10 = 1 THEN 'outside' WHEN p_type = 'PROMO' OR c.l_linestatus = 'O' THEN 'resolved' WHEN c.carries THEN 'unresolved' ELSE 'clean' END AS outcome
FROM c JOIN orders ON o_orderkey = c.l_orderkey JOIN part ON p_partkey = c.l_partkey) GROUP BY o_orderstatus, outcome
""")
def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to follow calls by outcome: a trail is lost only where taint is carried and the chain stays inside; distinct attempts count, not retries."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", (F.col("l_quantity") >= 25).alias("carries")).distinct()
    j = c.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("caller")), "l_orderkey")
    j = j.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type"), "l_partkey")
    outcome = F.when(F.col("p_size") % 10 == 1, "outside").when((F.col("p_type") == "PROMO") | (F.col("l_linestatus") == "O"), "resolved").when(F.col("carries"), "unresolved").otherwise("clean")
    return j.groupBy("caller", outcome.alias("outcome")).agg(F.count("*").alias("attempts"))


@registered("""
WITH RECURSIVE n AS (SELECT max(p_partkey) + 1 AS n FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 3 + 1) % n AS dst FROM part, n WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size % 5 = 0),
w AS (SELECT p_partkey AS root, p_partkey AS here FROM part WHERE p_type = 'PROMO' AND p_size < 10 UNION SELECT w.root, e.dst FROM w JOIN e ON e.src = w.here)
SELECT root, here AS template FROM w
""")
def template_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template that a view's data reaches through includes and layouts; templates that include each other end the walk by themselves."""
    p = table(spark, sf_dir, "part")
    n = p.agg((F.max("p_partkey") + 1).alias("n"))
    includes = p.where("p_size % 3 = 0").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 3 + 1) % F.col("n")).alias("dst"))
    layouts = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey DIV 2").alias("dst"))
    kind = F.lit("template")
    edges = includes.unionByName(layouts).select(kind.alias("src_kind"), "src", kind.alias("dst_kind"), "dst", F.lit(100).alias("conf"), F.lit(0).alias("clears"))
    views = p.where("p_type = 'PROMO' AND p_size < 10").select(F.col("p_partkey").alias("root"), kind.alias("kind"), F.col("p_partkey").alias("key"), F.lit(ALL).alias("mask"))
    return taint_walk(edges, views).select("root", F.col("key").alias("template"))


@registered(f"""
WITH l AS (SELECT l_orderkey, l_returnflag, bit_or(1 << CAST(l_partkey % 12 AS INTEGER)) AS m FROM lineitem GROUP BY l_orderkey, l_returnflag),
i AS (SELECT l_orderkey, l_returnflag, m & ~(CASE l_returnflag WHEN 'R' THEN {mask('html', 'js')} WHEN 'N' THEN {mask('sql', 'html')} ELSE 0 END) AS m FROM l)
SELECT l_orderkey AS tree, l_returnflag AS node, CAST(m AS INTEGER) AS mask FROM i UNION ALL SELECT l_orderkey, 'top', CAST(bit_or(m) AS INTEGER) FROM i GROUP BY l_orderkey
""")
def expression_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint of expressions from the leaves up: lines are leaves, a flag is a call or cast around its lines, an order joins them."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_partkey").count()
    bit = F.expr("shiftleft(1, CAST(l_partkey % 12 AS INT))")
    leaf = l.select(F.col("l_orderkey").alias("tree"), F.concat("l_returnflag", F.lit(":"), "l_partkey").alias("node"), F.col("l_returnflag").alias("parent"), F.lit(2).alias("depth"), bit.alias("own"), F.lit(0).alias("clears"))
    clears = F.when(F.col("parent") == "R", mask("html", "js")).when(F.col("parent") == "N", mask("sql", "html")).otherwise(0)
    inner = leaf.select("tree", "parent").distinct().select("tree", F.col("parent").alias("node"), F.lit("top").alias("parent"), F.lit(1).alias("depth"), F.lit(0).alias("own"), clears.alias("clears"))
    top = leaf.select("tree").distinct().select("tree", F.lit("top").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("own"), F.lit(0).alias("clears"))
    return fold_tree(leaf.unionByName(inner).unionByName(top)).where(~F.col("node").contains(":"))


@registered("""
SELECT conv_id, arg_min(length(text), turn) AS source_length, min(turn) AS at, count(*) AS sources FROM conversations WHERE role = 'user' AND length(text) > 20 GROUP BY conv_id
""")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of each method in its order and how many follow."""
    t = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.length("text") > 20))
    return t.groupBy("conv_id").agg(F.min_by(F.length("text").cast("long"), "turn").alias("source_length"), F.min("turn").alias("at"), F.count("*").alias("sources"))


@registered("""
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus, l_quantity >= 10 AS tainted FROM lineitem),
st AS (SELECT l_orderkey, l_linenumber AS step, 0 AS part, 'call' AS role FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM s) UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 1, 'weak-control' FROM s WHERE l_linestatus = 'F' AND tainted)
SELECT l_orderkey, step, role, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY step, part) - 1 AS INTEGER) AS place FROM st
""")
def weak_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a marker step wherever a control that clears nothing touches taint, numbered from 0 in order."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 10)).alias("weak"))
    per = s.groupBy("l_orderkey", "step").agg(F.bool_or("weak").alias("weak"))
    steps = per.groupBy("l_orderkey").agg(F.collect_list(F.struct("step", "weak")).alias("s"))
    marked = with_markers(F.col("s"))
    return steps.select("l_orderkey", F.posexplode(marked).alias("place", "x")).select("l_orderkey", "x.step", "x.role", "place")


@registered("""
WITH s AS (SELECT DISTINCT user_id, event_id AS span_id, event_id % 97 AS start, event_id % 97 + event_id % 31 AS stop, event_type FROM events WHERE event_id % 3 = 0),
p AS (SELECT DISTINCT user_id, event_id, event_id % 89 AS line FROM events WHERE event_id % 3 <> 0 AND event_type = 'error'),
r AS (SELECT p.user_id, s.event_type, s.span_id, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY s.stop - s.start, s.span_id) AS rn FROM p JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.start AND s.stop)
SELECT DISTINCT user_id, event_type AS construct, span_id FROM r WHERE rn = 1
""")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct failures: each error by the smallest named construct around it; errors in none are left out."""
    e = table(spark, sf_dir, "events")
    spans = e.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("span_id"), F.expr("event_id % 97").alias("start"), F.expr("event_id % 97 + event_id % 31").alias("stop"), "event_type").distinct()
    points = e.where("event_id % 3 <> 0 AND event_type = 'error'").select("user_id", "event_id", F.expr("event_id % 89").alias("line")).distinct()
    found = innermost(points, spans, "user_id", "line").where("span_id IS NOT NULL").select("user_id", "span_id").distinct()
    return found.join(spans.select("user_id", "span_id", F.col("event_type").alias("construct")), ["user_id", "span_id"]).select("user_id", "construct", "span_id")


@registered(r"""
WITH j AS (SELECT n_name AS prefix, 'src/' || n_nationkey || CASE WHEN n_nationkey % 6 = 5 THEN '/../../up' ELSE '' END AS dir, false AS dev FROM nation UNION SELECT r_name, 'tests/' || r_regionkey, true FROM region UNION SELECT n_name, 'src/' || n_nationkey, false FROM nation WHERE n_nationkey % 2 = 0)
SELECT prefix, dir, dev, regexp_matches(dir, '(^|/)\.\.(/|$)') AS rejected FROM j
""")
def autoload_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of both maps, each once; a directory that climbs out of the project is rejected, not dropped."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    at = F.concat(F.lit("src/"), "n_nationkey")
    main = n.select(F.col("n_name").alias("prefix"), F.concat(at, F.when(F.col("n_nationkey") % 6 == 5, "/../../up").otherwise("")).alias("dir"), F.lit(False).alias("dev"))
    again = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("prefix"), at.alias("dir"), F.lit(False).alias("dev"))
    dev = r.select(F.col("r_name").alias("prefix"), F.concat(F.lit("tests/"), "r_regionkey").alias("dir"), F.lit(True).alias("dev"))
    return main.unionByName(dev).unionByName(again).distinct().withColumn("rejected", F.col("dir").rlike(r"(^|/)\.\.(/|$)"))


@registered("""
WITH e AS (SELECT user_id, event_type, event_id % 3 AS layer, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
v AS (SELECT user_id, event_type, arg_max(k, layer * 1000000000000 + event_id) AS k FROM e WHERE k IS NOT NULL GROUP BY user_id, event_type),
d(event_type, dflt) AS (VALUES ('click', 1), ('view', 2), ('error', 3), ('signup', 4), ('purchase', 5)), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, '{' || string_agg('"' || d.event_type || '":' || coalesce(v.k, d.dflt), ',' ORDER BY d.event_type) || '}' AS config FROM u CROSS JOIN d LEFT JOIN v ON v.user_id = u.user_id AND v.event_type = d.event_type GROUP BY u.user_id
""")
def merged_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration layers merged, the highest layer and its last write winning, defaults where no layer speaks, dumped with sorted keys."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct((F.col("event_id") % 3).alias("layer"), "event_id").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    defaults = [("click", 1), ("view", 2), ("error", 3), ("signup", 4), ("purchase", 5)]
    won = e.groupBy("user_id").agg(*[F.coalesce(F.max_by(F.when(F.col("event_type") == name, F.col("k")), F.when((F.col("event_type") == name) & F.col("k").isNotNull(), F.col("at"))), F.lit(value)).alias(name) for name, value in defaults])
    return won.select("user_id", F.to_json(F.struct(*sorted(name for name, _ in defaults))).alias("config"))


@registered("""
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN 'other' ELSE lower(p_type) || 's' END AS tbl, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END AS fillable FROM part),
col AS (SELECT lower(p_type) || 's' AS tbl, list(DISTINCT w) AS cols FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size % 5 = 0) GROUP BY 1)
SELECT m.p_partkey, m.tbl AS "table", CASE WHEN m.fillable IS NULL THEN 'unreadable' WHEN len(m.fillable) = 0 THEN 'open' WHEN len(list_filter(m.fillable, lambda x: regexp_matches(x, '(?i)^(hot|is_admin|ring)$') AND (col.cols IS NULL OR list_contains(col.cols, x)))) > 0 THEN 'privileged' ELSE 'guarded' END AS protection FROM m LEFT JOIN col ON col.tbl = m.tbl
""")
def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model protection with the columns that migrations give its table: a fillable column is privileged by name if the table has it or is not known."""
    p = table(spark, sf_dir, "part")
    tbl = F.concat(F.lower("p_type"), F.lit("s"))
    fillable = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    m = p.select("p_partkey", F.when(F.col("p_size") % 8 == 0, "other").otherwise(tbl).alias("table"), fillable.alias("fillable"))
    columns = p.where("p_size % 5 = 0").select(tbl.alias("table"), F.explode(F.split("p_name", " ")).alias("w")).groupBy("table").agg(F.collect_set("w").alias("cols"))
    j = m.join(columns, "table", "left")
    privileged = F.exists("fillable", lambda x: x.rlike("(?i)^(hot|is_admin|ring)$") & (F.col("cols").isNull() | F.array_contains("cols", x)))
    kind = F.when(F.col("fillable").isNull(), "unreadable").when(F.size("fillable") == 0, "open").when(privileged, "privileged").otherwise("guarded")
    return j.select("p_partkey", "table", kind.alias("protection"))


@registered(r"""
WITH a AS (SELECT page_id, html, regexp_replace(html, '<!--[^>]*-->', '', 'g') AS t FROM pages), b AS (SELECT page_id, html, regexp_replace(t, '<script>[^<]*(</p>[^<]*)?</script>', '<?js ?>', 'g') AS t FROM a),
c AS (SELECT page_id, html, regexp_replace(t, '&([a-z]+);', '<?e(\1)?>', 'g') AS t FROM b)
SELECT page_id, md5(t) AS rewritten, len(t) AS n_chars, len(string_split(t, chr(10))) = len(string_split(html, chr(10))) AS same_lines FROM c
""")
def template_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates rewritten in a fixed order (comments, script blocks, escapes) without a change of their lines."""
    t = F.regexp_replace(F.regexp_replace("html", "<!--[^>]*-->", ""), "<script>[^<]*(</p>[^<]*)?</script>", "<?js ?>")
    t = F.regexp_replace(t, "&([a-z]+);", r"<?e($1)?>")
    lines = lambda x: F.size(F.split(x, "\n", -1))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("rewritten"), F.length(t).alias("n_chars"), (lines(t) == lines(F.col("html"))).alias("same_lines"))


@registered("""
WITH f AS (SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank, l_returnflag AS rule, 'app/' || l_partkey AS path, l_linenumber AS line, l_suppkey AS col FROM lineitem)
SELECT rank, rule, path, line, col, row_number() OVER (ORDER BY rank, rule, path, line, col) AS place FROM f
""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's total order (severity, rule, path, line, column), numbered by ranges."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    f = table(spark, sf_dir, "lineitem").select(rank.alias("rank"), F.col("l_returnflag").alias("rule"), F.concat(F.lit("app/"), "l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("col")).distinct()
    return numbered(f, ["rank", "rule", "path", "line", "col"])


@registered(r"""
WITH c AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'htmlspecialchars' WHEN 'SMALL' THEN 'json_encode' WHEN 'STANDARD' THEN 'Js::from' WHEN 'PROMO' THEN 'strip_tags' ELSE '(int)' END AS call,
  CASE p_size % 4 WHEN 0 THEN 'JSON_HEX_TAG' WHEN 1 THEN 'JSON_PRETTY_PRINT | JSON_HEX_TAG' WHEN 2 THEN 'JSON_HEX_TAGS' END AS flags, (CASE WHEN p_size % 2 = 0 THEN 4095 ELSE 34 END) | (CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS taint FROM part),
k AS (SELECT *, CASE call WHEN 'htmlspecialchars' THEN 2 WHEN 'Js::from' THEN 34 WHEN '(int)' THEN 3 WHEN 'json_encode' THEN CASE WHEN list_contains(string_split(flags, ' | '), 'JSON_HEX_TAG') THEN 34 ELSE 0 END ELSE 0 END AS clears FROM c)
SELECT p_partkey, call, clears, taint & ~clears AS open FROM k
""")
def flagged_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two arguments, what each clears (one only with its flag) and the taint that it passes on from both."""
    call = F.when(F.col("p_type") == "ECONOMY", "htmlspecialchars").when(F.col("p_type") == "SMALL", "json_encode").when(F.col("p_type") == "STANDARD", "Js::from").when(F.col("p_type") == "PROMO", "strip_tags").otherwise("(int)")
    place = F.col("p_size") % 4
    flags = F.when(place == 0, "JSON_HEX_TAG").when(place == 1, "JSON_PRETTY_PRINT | JSON_HEX_TAG").when(place == 2, "JSON_HEX_TAGS")
    one = lambda value, taint: F.struct(value.alias("value"), taint.cast("int").alias("taint"))
    args = F.array(one(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, ALL).otherwise(mask("html", "js"))), one(flags, F.when(F.col("p_size") % 5 == 0, mask("sql"))))
    calls = table(spark, sf_dir, "part").select("p_partkey", call.alias("call"), args.alias("args"))
    return calls.select("p_partkey", "call", clears(F.col("call"), F.col("args")).alias("clears"), returned_taint(F.col("call"), F.col("args")).alias("open"))
