"""Route, configuration, entry-point and request queries. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.controls import CONTROLS, excluded, has_control, joined_uri, singular
from graphweave.functions.masks import ALL, mask
from graphweave.operators.ranking import first_of
from graphweave.operators.resolve import nearest_base
from graphweave.plans.flows import values
from graphweave.sources.driver_tables import table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Middleware that order priorities and statuses declare for a route, in order; a group stands for its members.
_DECLARED = [("1-URGENT", 0, "auth"), ("1-URGENT", 1, "throttle:60"), ("2-HIGH", 0, "web"), ("3-MEDIUM", 0, "signed"), ("3-MEDIUM", 1, "can:edit"), ("4-NOT SPECIFIED", 0, "guest"), ("O", 9, "verified"), ("F", 9, "custom"), ("P", 9, "password.confirm")]
_GROUPS = [("web", 0, "auth.session"), ("web", 1, "throttle:30"), ("custom", 0, "role:admin")]
_URIS = [("BUILDING", "login"), ("MACHINERY", "verify/{id}"), ("HOUSEHOLD", "orders/{order?}"), ("AUTOMOBILE", "/unsubscribe/"), ("FURNITURE", "profile")]
_ROUTES = f"""
WITH d(name, ord, mw) AS (VALUES {values(_DECLARED)}), grp(name, ord, member) AS (VALUES {values(_GROUPS)}), u(seg, uri) AS (VALUES {values(_URIS)}),
m AS (SELECT o.o_orderkey, d.ord, coalesce(grp.ord, 0) AS sub, coalesce(grp.member, d.mw) AS mw FROM orders o JOIN d ON d.name IN (o.o_orderpriority, o.o_orderstatus) LEFT JOIN grp ON grp.name = d.mw),
r AS (SELECT o.o_orderkey, '/' || regexp_replace(regexp_replace(lower(o.o_orderstatus) || '/' || u.uri, '/+', '/', 'g'), '^/|/$', '', 'g') AS uri, (SELECT string_agg(mw, ',' ORDER BY ord, sub) FROM m WHERE m.o_orderkey = o.o_orderkey) AS middleware
      FROM orders o JOIN customer ON c_custkey = o_custkey JOIN u ON u.seg = c_mktsegment)
"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, uri, middleware``: groups expanded where they stand, in declared order."""
    d = spark.createDataFrame(_DECLARED, "name string, ord int, mw string")
    g = spark.createDataFrame(_GROUPS, "mw string, sub int, member string")
    u = spark.createDataFrame(_URIS, "c_mktsegment string, uri string")
    expanded = d.join(g, "mw", "left").select("name", "ord", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("member", "mw").alias("mw"))
    # The lists belong to the few names, not to each route.
    lists = expanded.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "sub", "mw"))).alias("l"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(u), "c_mktsegment").select(F.col("c_custkey").alias("o_custkey"), "uri")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(c, "o_custkey")
    for column, out in (("o_orderpriority", "a"), ("o_orderstatus", "b")):
        o = o.join(F.broadcast(lists.toDF(column, out)), column, "left")
    none = F.array().cast("array<struct<ord:int,sub:int,mw:string>>")
    all_ = F.array_sort(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    return o.select("o_orderkey", joined_uri(F.lower("o_orderstatus"), F.col("uri")).alias("uri"), F.transform(all_, lambda x: x["mw"]).alias("middleware"))


def _matches(control: str) -> str:
    return " OR ".join(f"',' || coalesce(middleware, '') LIKE '%,{name}{end}'" for name in CONTROLS[control] for end in ("", ",%", ":%"))


@registered(_ROUTES + "SELECT o_orderkey, uri, middleware, " + ", ".join(f"({_matches(c)}) AS {c}" for c in CONTROLS) + " FROM r")
def route_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven controls of every route by its middleware, group members in the group's place; names compare up to the colon."""
    r = _routes(spark, sf_dir)
    return r.select("o_orderkey", "uri", F.nullif(F.array_join("middleware", ","), F.lit("")).alias("middleware"), *[has_control(F.col("middleware"), c).alias(c) for c in CONTROLS])


@registered(_ROUTES + f"""
SELECT o_orderkey, uri, rule FROM (
  SELECT o_orderkey, uri, 'unauthenticated' AS rule FROM r WHERE NOT ({_matches('authenticated')}) AND NOT ({_matches('guest')}) AND uri LIKE '%profile'
  UNION ALL SELECT o_orderkey, uri, 'no-throttle' FROM r WHERE uri LIKE '%/login' AND NOT ({_matches('limited')})
  UNION ALL SELECT o_orderkey, uri, 'unsigned' FROM r WHERE (uri LIKE '%verify%' OR uri LIKE '%unsubscribe%') AND NOT ({_matches('signed')}))
""")
def route_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that lack the control their address calls for: a login, a rate limit on sign-in, a signature on links that are sent out."""
    r = _routes(spark, sf_dir)
    has = lambda c: has_control(F.col("middleware"), c)
    uri = F.col("uri")
    rules = F.filter(F.array(
        F.when(~has("authenticated") & ~has("guest") & uri.endswith("profile"), "unauthenticated"),
        F.when(uri.endswith("/login") & ~has("limited"), "no-throttle"),
        F.when((uri.contains("verify") | uri.contains("unsubscribe")) & ~has("signed"), "unsigned"),
    ), lambda x: x.isNotNull())
    return r.select("o_orderkey", "uri", F.explode(rules).alias("rule"))


@registered(_ROUTES + r"""
SELECT o_orderkey, uri, regexp_replace(param, '[{}?]', '', 'g') AS param, param LIKE '%?}' AS optional, CASE WHEN regexp_replace(param, '[{}?]', '', 'g') IN ('id', 'order') THEN 'string' END AS declared
FROM (SELECT o_orderkey, uri, unnest(regexp_extract_all(uri, '\{[a-z]+\??\}')) AS param FROM r)
""")
def route_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a route's address met by name with those its action declares; an optional one has a question mark."""
    declared = spark.createDataFrame([("id", "string"), ("order", "string"), ("user", "int")], "param string, declared string")
    rows = _routes(spark, sf_dir).select("o_orderkey", "uri", F.explode(F.regexp_extract_all("uri", F.lit(r"(\{[a-z]+\??\})"), F.lit(1))).alias("p"))
    rows = rows.select("o_orderkey", "uri", F.regexp_replace("p", "[{}?]", "").alias("param"), F.col("p").endswith("?}").alias("optional"))
    return rows.join(F.broadcast(declared), "param", "left").select("o_orderkey", "uri", "param", "optional", "declared")


@registered("""
WITH p AS (SELECT DISTINCT string_split(regexp_replace(url, '^https?://', ''), '/') AS s, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
SELECT path, list_contains(string_split(path, '/'), 'fr') OR list_contains(string_split(path, '/'), 'de') AS excluded, CASE WHEN split_part(path, '/', 2) LIKE '%ies' THEN regexp_replace(split_part(path, '/', 2), 'ies$', 'y') ELSE regexp_replace(split_part(path, '/', 2), 's$', '') END AS resource, count(*) AS urls FROM p GROUP BY ALL
""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with whether a segment excludes them from the scan, and the resource their first directory stands for."""
    url = F.regexp_replace("url", "^https?://", "")
    p = table(spark, sf_dir, "pages").select("url").distinct().select(F.regexp_replace(url, "[?#].*$", "").alias("path"), F.split(url, "/").alias("s")).distinct()
    first = F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))
    return p.groupBy("path").agg(F.count("*").alias("urls")).select("path", excluded(F.col("path"), ["fr", "de"]).alias("excluded"), singular(first).alias("resource"), "urls")


#: Configuration keys (events stand for them) with the values below or above which a rule holds, and what is secret.
_CHECKS = [("debug-enabled", "error", 50, None), ("app-key", "signup", None, 10), ("trusted-proxies", "view", 90, None), ("session-cookie", "click", None, 20), ("session-lifetime", "click", 95, None)]


@registered(f"""
WITH ck(rule, key, above, below) AS (VALUES {values(_CHECKS)}),
c AS (SELECT user_id, event_type AS key, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS value, count(*) AS writes FROM events GROUP BY user_id, event_type)
SELECT c.user_id, c.key, ck.rule, CASE WHEN c.key = 'signup' THEN '[REDACTED]' ELSE CAST(c.value AS VARCHAR) END AS value, c.writes FROM c JOIN ck ON ck.key = c.key WHERE c.value > ck.above OR c.value < ck.below
""")
def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration as its last write leaves it, held against what each key may be; secrets are shown redacted."""
    checks = spark.createDataFrame(_CHECKS, "rule string, key string, above int, below int")
    value = F.get_json_object("props", "$.k").cast("int")
    c = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by(value, "event_id").alias("value"), F.count("*").alias("writes"))
    hit = c.join(F.broadcast(checks), "key").where((F.col("value") > F.col("above")) | (F.col("value") < F.col("below")))
    shown = F.when(F.col("key") == "signup", "[REDACTED]").otherwise(F.col("value").cast("string"))
    return hit.select("user_id", "key", "rule", shown.alias("value"), "writes")


#: Parents and the kind of entry point that their classes are; path and parent decide, then the method each kind is entered by.
_PARENTS = [("BUILDING", "job", "handle"), ("MACHINERY", "command", "handle"), ("HOUSEHOLD", "listener", "handle"), ("AUTOMOBILE", "observer", None)]


@registered(f"""
WITH k(parent, kind, method) AS (VALUES {values(_PARENTS)}),
m AS (SELECT o_orderkey, c_mktsegment AS parent, CASE o_orderstatus WHEN 'O' THEN 'handle' WHEN 'F' THEN 'created' ELSE 'helper' END AS method, CASE WHEN c_acctbal > 8000 THEN 'app/Jobs' ELSE 'app/Other' END AS dir FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE WHEN dir = 'app/Jobs' THEN 'job' ELSE k.kind END AS kind, m.method FROM m LEFT JOIN k ON k.parent = m.parent
WHERE CASE WHEN dir = 'app/Jobs' THEN m.method = 'handle' WHEN k.kind IS NULL THEN false WHEN k.method IS NULL THEN m.method <> 'helper' ELSE m.method = k.method END
""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that something outside enters: by directory first, else by the class's parent; each kind is entered by its own methods."""
    kinds = spark.createDataFrame(_PARENTS, "parent string, known string, enters string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("parent"), F.when(F.col("c_acctbal") > 8000, "app/Jobs").otherwise("app/Other").alias("dir"))
    method = F.when(F.col("o_orderstatus") == "O", "handle").when(F.col("o_orderstatus") == "F", "created").otherwise("helper")
    m = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", method.alias("method")).join(c, "o_custkey").join(F.broadcast(kinds), "parent", "left")
    job = F.col("dir") == "app/Jobs"
    enters = F.when(job, F.col("method") == "handle").when(F.col("known").isNull(), F.lit(False)).when(F.col("enters").isNull(), F.col("method") != "helper").otherwise(F.col("method") == F.col("enters"))
    return m.where(enters).select("o_orderkey", F.when(job, "job").otherwise(F.col("known")).alias("kind"), "method")


#: Server variables that the client sets, and the kinds each source carries; others of the server are clean.
_SOURCES = [("click", ALL), ("view", ALL & ~mask("mass_assign")), ("purchase", 0)]


@registered(f"""
WITH s(name, kinds) AS (VALUES {values(_SOURCES)}), r AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k IS NULL OR k < 10 OR k IN (20, 30, 40) THEN {ALL} ELSE 0 END ELSE coalesce(s.kinds, 0) END AS INTEGER) AS kinds, s.name IS NOT NULL OR event_type = 'error' AS known FROM r LEFT JOIN s ON s.name = r.event_type
""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each read of a global carries: all kinds, some, or by key (client-set keys and unreadable ones carry all, other keys nothing)."""
    sources = spark.createDataFrame(_SOURCES, "event_type string, carried int")
    k = F.get_json_object("props", "$.k").cast("int")
    j = table(spark, sf_dir, "events").join(F.broadcast(sources), "event_type", "left")
    keyed = F.when(k.isNull() | (k < 10) | k.isin(20, 30, 40), ALL).otherwise(0)
    server = F.col("event_type") == "error"
    return j.select("event_id", F.when(server, keyed).otherwise(F.coalesce("carried", F.lit(0))).cast("int").alias("kinds"), (F.col("carried").isNotNull() | server).alias("known"))


@registered("""
WITH v AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'), a AS (SELECT conv_id, min(turn) AS at, count(*) AS uses FROM conversations WHERE role = 'user' AND length(text) > 200 GROUP BY conv_id)
SELECT a.conv_id, a.at, a.uses FROM a WHERE a.conv_id IN (SELECT conv_id FROM v)
""")
def validated_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that validate (a system turn stands for it) and still read the whole request (a long user turn): the first such read and their number."""
    t = table(spark, sf_dir, "conversations")
    reads = t.where((F.col("role") == "user") & (F.length("text") > 200)).groupBy("conv_id").agg(F.min("turn").alias("at"), F.count("*").alias("uses"))
    return reads.join(t.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi")


@registered("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, max(CASE WHEN l_tax > 0.01 THEN 'because ' || l_linestatus END) AS justification FROM lineitem WHERE l_quantity = 5 GROUP BY 1, 2, 3),
f AS (SELECT r.o_orderkey, r.o_orderpriority FROM orders r WHERE r.o_orderstatus = 'O')
SELECT s.l_orderkey, s.l_linenumber, s.l_returnflag, CASE WHEN s.justification IS NULL THEN 'bare-ignore' WHEN f.o_orderkey IS NOT NULL THEN 'form-request-true' END AS rule
FROM s LEFT JOIN f ON f.o_orderkey = s.l_orderkey WHERE s.justification IS NULL OR f.o_orderkey IS NOT NULL
""")
def ignored_or_always_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions without a reason are findings themselves; others are where the request they guard always says yes."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 5")
    s = lines.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max(F.when(F.col("l_tax") > 0.01, F.concat(F.lit("because "), "l_linestatus"))).alias("justification"))
    true = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("always"))
    rule = F.when(F.col("justification").isNull(), "bare-ignore").when(F.col("always"), "form-request-true")
    return s.join(true, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_returnflag", rule.alias("rule")).where("rule IS NOT NULL")


@registered("""
WITH RECURSIVE c AS (SELECT p_partkey AS k, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_partkey // 3 END AS up, p_brand IN ('Brand#1', 'Brand#2') AS base FROM part),
w AS (SELECT k, k AS at, 0 AS d FROM c UNION SELECT w.k, c.up, w.d + 1 FROM w JOIN c ON c.k = w.at WHERE c.up IS NOT NULL AND w.d < 15)
SELECT w.k AS p_partkey, CAST(min(w.d) AS INTEGER) AS steps FROM w JOIN c ON c.k = w.at WHERE c.base GROUP BY w.k
""")
def model_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with a known base among their ancestors, themselves included, and the steps to the nearest."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("type"), F.when(F.col("p_size") % 9 != 0, F.expr("p_partkey DIV 3")).alias("parent"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("base"))
    return nearest_base(parts).select(F.col("type").alias("p_partkey"), "steps")


@registered("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM r
""")
def route_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of each file in the order of their lines."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return first_of(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2**31 - 1, "place").select("o_custkey", "o_orderkey", "place")
