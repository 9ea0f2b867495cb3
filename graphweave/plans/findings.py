"""Rule, assembly and history queries. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweave.functions.identity import digest16
from graphweave.functions.masks import ALL, cleared, mask, union
from graphweave.functions.patterns import SEVERITIES, glob_pattern, safe_rate, severity_name
from graphweave.operators.ranking import first_of, innermost
from graphweave.sources.driver_tables import table

QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = "(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, CAST(100 - round(100 * l_discount) AS INTEGER) AS conf FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = (100 - F.round(100 * F.col("l_discount"))).cast("int").alias("conf")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", conf).distinct()


@registered(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY conf DESC, l_linenumber, l_orderkey, l_suppkey, l_quantity, l_linestatus) AS rn,
           count(*) OVER (PARTITION BY l_returnflag, l_partkey) AS n FROM {_LINES})
SELECT l_returnflag AS rule, l_partkey AS sink, l_orderkey AS entry, conf, n - 1 AS alternatives FROM r WHERE rn = 1
""")
def primary_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule and sink the surest path, then the shortest, then the least; the others are alternatives."""
    rows = _lines(spark, sf_dir)
    order = F.struct((-F.col("conf")).alias("doubt"), "l_linenumber", "l_orderkey", "l_suppkey", "l_quantity", "l_linestatus")
    best = rows.groupBy("l_returnflag", "l_partkey").agg(F.min(order).alias("b"), (F.count("*") - 1).alias("alternatives"))
    return best.select(F.col("l_returnflag").alias("rule"), F.col("l_partkey").alias("sink"), F.col("b.l_orderkey").alias("entry"), (-F.col("b.doubt")).alias("conf"), "alternatives")


@registered("""
WITH g AS (SELECT l_returnflag, l_partkey, bool_or(o_orderstatus = 'O' AND o_orderpriority LIKE '1-%') AS open, bool_or(o_orderstatus = 'O') AS http, min(100 - round(100 * l_discount)) AS weakest
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag, l_partkey),
s AS (SELECT *, least(4, CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 2 END + CASE WHEN open THEN 1 WHEN NOT http THEN -1 ELSE 0 END) AS raised FROM g)
SELECT l_returnflag AS rule, l_partkey AS sink, list_extract(['info', 'low', 'medium', 'high', 'critical'], CAST(greatest(0, raised - CASE WHEN weakest < 92 THEN 1 ELSE 0 END) AS INTEGER) + 1) AS severity, weakest < 92 AS needs_review FROM s
""")
def severity_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up one step for an open entry, down one without any HTTP entry, then down one and to review for an unsure path; ends of the ladder hold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    http = F.col("o_orderstatus") == "O"
    g = j.groupBy("l_returnflag", "l_partkey").agg(F.bool_or(http & F.col("o_orderpriority").startswith("1-")).alias("open"), F.bool_or(http).alias("http"), F.min(100 - F.round(100 * F.col("l_discount"))).alias("weakest"))
    base = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 3).otherwise(2)
    raised = F.least(F.lit(len(SEVERITIES) - 1), base + F.when(F.col("open"), 1).when(~F.col("http"), -1).otherwise(0))
    unsure = F.col("weakest") < 92
    return g.select(F.col("l_returnflag").alias("rule"), F.col("l_partkey").alias("sink"), severity_name(raised - F.when(unsure, 1).otherwise(0)).alias("severity"), unsure.alias("needs_review"))


@registered(f"""
SELECT l_orderkey, CAST(bit_or(1 << (CAST(l_partkey AS INTEGER) % 12)) AS INTEGER) AS taint, CAST(bit_or(CASE WHEN l_linestatus = 'F' THEN 1 << (CAST(l_suppkey AS INTEGER) % 12) ELSE 0 END) AS INTEGER) AS cleared,
       CAST(bit_or(1 << (CAST(l_partkey AS INTEGER) % 12)) & ~bit_or(CASE WHEN l_linestatus = 'F' THEN 1 << (CAST(l_suppkey AS INTEGER) % 12) ELSE 0 END) AS INTEGER) AS open FROM {_LINES} GROUP BY l_orderkey
""")
def taint_mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    bit = lambda c: F.expr(f"shiftleft(1, CAST({c} % 12 AS INT))")
    g = rows.groupBy("l_orderkey").agg(union(bit("l_partkey")).alias("taint"), union(F.when(F.col("l_linestatus") == "F", bit("l_suppkey")).otherwise(0)).alias("cleared"))
    return g.withColumn("open", cleared(F.col("taint"), F.col("cleared")))


_HTML, _INT, _SHELL, _PATH = mask("html"), mask("sql", "html", "path"), mask("shell"), mask("path")


@registered(f"""
WITH s(p_type, clears) AS (VALUES ('ECONOMY', {_HTML}), ('SMALL', {_INT}), ('STANDARD', {_SHELL}), ('PROMO', {_PATH}))
SELECT p_partkey, {ALL} & ~coalesce(s.clears, 0) AS open, coalesce(s.clears, 0) <> 0 AS sanitized FROM part LEFT JOIN s ON s.p_type = part.p_type
""")
def sanitizer_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sanitizer clears exactly the kinds it declares; an unknown call clears none."""
    known = spark.createDataFrame([("ECONOMY", _HTML), ("SMALL", _INT), ("STANDARD", _SHELL), ("PROMO", _PATH)], "p_type string, clears int")
    j = table(spark, sf_dir, "part").join(F.broadcast(known), "p_type", "left")
    clears = F.coalesce("clears", F.lit(0))
    return j.select("p_partkey", cleared(F.lit(ALL), clears).alias("open"), (clears != 0).alias("sanitized"))


@registered("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS last_write, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS version
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write before each statement and the version each write makes."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("role") == "user", F.length("text").cast("long"))
    version = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.last(write, ignorenulls=True).over(before).alias("last_write"), version.alias("version"))


@registered("""
WITH a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS arg, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
b AS (SELECT p_partkey, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS param, unnest([0, 1, 2]) AS pos FROM part)
SELECT b.p_partkey, b.pos, b.param, a.arg FROM b LEFT JOIN a ON a.p_partkey = b.p_partkey AND a.pos = b.pos
""")
def arg_param_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments meet parameters by position; a parameter without an argument keeps null."""
    params, args = F.array("p_brand", "p_type", F.col("p_size").cast("string")), F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(params).alias("pos", "param"), args.alias("args"))
    return rows.select("p_partkey", "pos", "param", F.get("args", F.col("pos")).alias("arg"))


@registered("""
WITH st AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 7 = 0), nm AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)
SELECT p.p_partkey, 'receiver' AS matched FROM part p JOIN st USING (p_brand, p_type) UNION ALL SELECT p.p_partkey, 'name' FROM part p JOIN nm USING (p_brand)
""")
def sink_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call may match a sink by receiver and method and another by method alone; both count."""
    p = table(spark, sf_dir, "part")
    by_receiver = p.where("p_size % 7 = 0").select("p_brand", "p_type").distinct()
    by_name = p.where("p_size = 50").select("p_brand").distinct()
    one = p.join(by_receiver, ["p_brand", "p_type"]).select("p_partkey", F.lit("receiver").alias("matched"))
    return one.unionByName(p.join(by_name, "p_brand").select("p_partkey", F.lit("name").alias("matched")))


@registered("""
WITH s AS (SELECT DISTINCT user_id, event_id AS span_id, event_id % 97 AS start, event_id % 97 + event_id % 11 AS stop FROM events WHERE event_id % 3 = 0),
p AS (SELECT DISTINCT user_id, event_id, event_id % 89 AS line FROM events WHERE event_id % 3 <> 0),
r AS (SELECT p.user_id, p.event_id, p.line, s.span_id, s.stop - s.start AS width, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY s.stop - s.start, s.span_id) AS rn
      FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.start AND s.stop)
SELECT user_id, event_id, line, span_id, width FROM r WHERE rn = 1
""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    spans = e.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("span_id"), F.expr("event_id % 97").alias("start"), F.expr("event_id % 97 + event_id % 11").alias("stop")).distinct()
    points = e.where("event_id % 3 <> 0").select("user_id", "event_id", F.expr("event_id % 89").alias("line")).distinct()
    return innermost(points, spans, "user_id", "line")


@registered(f"""
WITH f AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM {_LINES}), s AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber + 1 AS l_linenumber FROM {_LINES} WHERE l_quantity % 5 = 0)
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = f.l_orderkey AND s.l_returnflag = f.l_returnflag AND s.l_linenumber = f.l_linenumber)
""")
def suppress_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    marks = rows.where("l_quantity % 5 = 0").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") + 1).alias("l_linenumber")).distinct()
    return rows.select("l_orderkey", "l_returnflag", "l_linenumber").distinct().join(marks, ["l_orderkey", "l_returnflag", "l_linenumber"], "left_anti")


_GLOBS = [("*ring", "2999-01-01"), ("red*", "2000-01-01"), ("?lue *", None), ("hot b*t", "not a date")]


@registered("""
SELECT p_partkey, p_name FROM part WHERE NOT (p_name LIKE '%ring' OR p_name LIKE '_lue %' OR p_name LIKE 'hot b%t')
""")
def suppress_glob_expiry(spark: SparkSession, sf_dir: str, as_of: str = "2026-01-01") -> DataFrame:
    """Globs suppress until they expire as of a given date; none or an invalid date means never."""
    rules = spark.createDataFrame([(glob_pattern(g), e) for g, e in _GLOBS], "pattern string, expires string")
    until = F.try_to_date(F.col("expires"), "yyyy-MM-dd")
    active = rules.where(until.isNull() | (until >= F.lit(as_of).cast("date"))).select("pattern")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(F.broadcast(active), F.rlike(F.col("p_name"), F.col("pattern")), "left_anti")


_DAY = "date_trunc('day', ts)"


@registered("""
WITH f AS (SELECT DISTINCT substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR), CAST(event_id % 5 AS VARCHAR))), 1, 16) AS fingerprint, ts < TIMESTAMP '2024-01-11' AS early FROM events)
SELECT DISTINCT fingerprint FROM f WHERE NOT early AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE early)
""")
def baseline_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select(digest16(F.col("event_type"), F.col("user_id"), F.col("event_id") % 5).alias("fingerprint"), (F.col("ts") < F.lit("2024-01-11").cast("timestamp")).alias("early"))
    return f.where("NOT early").select("fingerprint").distinct().join(f.where("early").select("fingerprint").distinct(), "fingerprint", "left_anti")


@registered("""
WITH d AS (SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO' UNION SELECT p_partkey FROM part WHERE p_name LIKE '%ring')
SELECT k AS p_partkey FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = k AND l_returnflag = 'R' AND l_quantity >= 40)
""")
def dead_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies, explicit or by name, that nothing refers to."""
    p = table(spark, sf_dir, "part")
    declared = p.where("p_type = 'PROMO'").select("p_partkey").union(p.where(F.col("p_name").endswith("ring")).select("p_partkey")).distinct()
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return declared.join(used, "p_partkey", "left_anti")


@registered("""
WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority <> '1-URGENT' AS authorised FROM orders)
SELECT o_custkey, o_orderkey FROM (SELECT *, bool_or(authorised) OVER (PARTITION BY o_custkey) AS any_authorised FROM a) WHERE any_authorised AND NOT authorised
""")
def inconsistent_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") != "1-URGENT").alias("authorised"))
    some = F.bool_or("authorised").over(Window.partitionBy("o_custkey"))
    return a.withColumn("any_authorised", some).where("any_authorised AND NOT authorised").select("o_custkey", "o_orderkey")


@registered("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
""")
def missing_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes behind a login with neither a gate nor an authorising call."""
    routes = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    gated = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    trusted = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return routes.join(gated, "o_orderkey", "left_anti").join(trusted, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@registered("""
WITH x(uri) AS (VALUES ('1-urgent'), ('9-none'), ('5*')), r AS (SELECT DISTINCT lower(o_orderpriority) AS uri FROM orders WHERE o_orderstatus <> 'F')
SELECT x.uri, (SELECT count(*) FROM r WHERE r.uri = x.uri) AS routes FROM x WHERE x.uri LIKE '%*%' OR x.uri IN (SELECT uri FROM r)
""")
def csrf_like_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions that hit a state-changing route, or hold a wildcard."""
    x = spark.createDataFrame([("1-urgent",), ("9-none",), ("5*",)], "uri string")
    r = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.lower("o_orderpriority").alias("uri")).distinct()
    counted = x.join(r.withColumn("hit", F.lit(1)), "uri", "left").groupBy("uri").agg(F.count("hit").alias("routes"))
    return counted.where(F.col("uri").contains("*") | (F.col("routes") > 0))


@registered("""
SELECT event_id, 'props.' || k AS key, CASE WHEN upper(k) LIKE '%SECRET%' OR upper(k) LIKE '%KEY%' THEN '[REDACTED]' ELSE json_extract_string(props, '$.' || k) END AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def config_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    secret = F.upper("k").rlike("SECRET|KEY")
    return e.select("event_id", F.concat(F.lit("props."), "k").alias("key"), F.when(secret, "[REDACTED]").otherwise(F.col("v")).alias("value"))


@registered("""
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN [] ELSE [p_name, p_type] END AS guarded, p_type FROM part)
SELECT p_partkey, CASE WHEN guarded IS NULL THEN 'unreadable' WHEN len(guarded) = 0 THEN 'open' WHEN regexp_matches(p_type, '(?i)^(promo|is_admin)$') THEN 'privileged' ELSE 'guarded' END AS protection FROM m
""")
def model_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty guard list leaves a model open; an unreadable one says nothing."""
    guarded = F.when(F.expr("p_size % 4 = 0"), None).when(F.expr("p_size % 4 = 1"), F.array().cast("array<string>")).otherwise(F.array("p_name", "p_type"))
    m = table(spark, sf_dir, "part").select("p_partkey", guarded.alias("guarded"), "p_type")
    kind = F.when(F.col("guarded").isNull(), "unreadable").when(F.size("guarded") == 0, "open").when(F.col("p_type").rlike("(?i)^(promo|is_admin)$"), "privileged").otherwise("guarded")
    return m.select("p_partkey", kind.alias("protection"))


@registered("""
WITH d AS (SELECT d.source, count(*) AS files, count(l.doc_id) AS read, count(*) FILTER (WHERE l.quality = 1) AS clean FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id GROUP BY d.source)
SELECT source, files, read, clean, round(CASE WHEN files = 0 THEN 1.0 ELSE read / files END, 6) AS parse_rate, round(CASE WHEN read = 0 THEN 1.0 ELSE clean / read END, 6) AS clean_rate FROM d
""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    g = d.groupBy("source").agg(F.count("*").alias("files"), F.count("labelled").alias("read"), F.count_if(F.col("quality") == 1).alias("clean"))
    return g.select("*", safe_rate(F.col("read"), F.col("files")).alias("parse_rate"), safe_rate(F.col("clean"), F.col("read")).alias("clean_rate"))


@registered("SELECT o_orderpriority AS severity, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, count(*) AS n FROM orders GROUP BY o_orderpriority")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))
    return g.select("severity", F.substring("severity", 1, 1).cast("int").alias("rank"), "n").orderBy("rank")


@registered("""
WITH v AS (SELECT d.source AS rule, CASE WHEN l.toxic IS NULL THEN 'unreviewed' WHEN l.toxic = 1 THEN 'true' ELSE 'false' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT rule, count(*) FILTER (WHERE verdict = 'true') AS hits, count(*) FILTER (WHERE verdict = 'false') AS misses, count(*) FILTER (WHERE verdict = 'unreviewed') AS unreviewed,
       round(count(*) FILTER (WHERE verdict = 'true') / nullif(count(*) FILTER (WHERE verdict <> 'unreviewed'), 0), 6) AS precision FROM v GROUP BY rule
""")
def precision_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision over reviewed findings; null where none was reviewed."""
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "toxic")
    v = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rule")).join(l, F.col("doc_id") == F.col("l_id"), "left")
    g = v.groupBy("rule").agg(F.count_if(F.col("toxic") == 1).alias("hits"), F.count_if(F.col("toxic") != 1).alias("misses"), F.count_if(F.col("toxic").isNull()).alias("unreviewed"))
    return g.withColumn("precision", F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 6))


@registered("""
WITH f AS (SELECT DISTINCT event_type AS rule, substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))), 1, 16) AS fingerprint FROM events)
SELECT rule, fingerprint, rn FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY fingerprint) AS rn FROM f) WHERE rn <= 20
""")
def review_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 fingerprints of each rule go to review."""
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), digest16(F.col("event_type"), F.col("user_id")).alias("fingerprint")).distinct()
    return first_of(f, ["rule"], [F.col("fingerprint")], 20)


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    scan = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("scan")
    return e.select(scan, digest16(F.col("event_type"), F.col("user_id")).alias("fingerprint")).distinct()


_SCANS = "(SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS scan, substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))), 1, 16) AS fingerprint FROM events)"


@registered(f"""
WITH a AS (SELECT DISTINCT fingerprint FROM {_SCANS} WHERE scan < 8), b AS (SELECT DISTINCT fingerprint FROM {_SCANS} WHERE scan BETWEEN 4 AND 12)
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'removed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.fingerprint = b.fingerprint
""")
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scans(spark, sf_dir)
    a = s.where("scan < 8").select("fingerprint").distinct().withColumn("a", F.lit(True))
    b = s.where("scan BETWEEN 4 AND 12").select("fingerprint").distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("state"))


@registered(f"SELECT scan, fingerprint, min(scan) OVER (PARTITION BY fingerprint) AS first_seen FROM {_SCANS}")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).withColumn("first_seen", F.min("scan").over(Window.partitionBy("fingerprint")))


@registered(f"SELECT s.scan, count(*) AS findings FROM {_SCANS} s WHERE s.scan = (SELECT max(scan) FROM {_SCANS}) GROUP BY s.scan")
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of greatest number, whatever its time."""
    counted = _scans(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("findings"))
    return counted.orderBy(F.desc("scan")).limit(1)


@registered("""
WITH e AS (SELECT l_orderkey, count(*) AS steps, min(l_linenumber) AS first_step, max(l_linenumber) AS last_step FROM lineitem WHERE (l_orderkey) IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') GROUP BY l_orderkey)
SELECT o.o_orderkey, c.c_name, coalesce(e.steps, 0) AS steps, e.first_step, e.last_step FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN e ON e.l_orderkey = o.o_orderkey WHERE o.o_orderpriority = '2-HIGH'
""")
def findings_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with file and evidence; evidence is read through a semi join on the findings' keys."""
    f = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_custkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(f, "o_orderkey", "left_semi")
    e = steps.groupBy("o_orderkey").agg(F.count("*").alias("steps"), F.min("l_linenumber").alias("first_step"), F.max("l_linenumber").alias("last_step"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return f.join(c, "o_custkey", "left").join(e, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("steps", F.lit(0)).alias("steps"), "first_step", "last_step")


@registered(r"""
SELECT page_id, unnest(regexp_extract_all(url, '[?&]([A-Za-z_]+)=', 1)) AS param, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '/+', '/', 'g') AS path FROM pages
""")
def uri_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "/+", "/")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[?&]([A-Za-z_]+)="), F.lit(1))).alias("param"), path.alias("path"))


@registered(r"""
SELECT page_id, len(regexp_extract_all(html, '<script[^>]*>')) AS scripts, len(regexp_extract_all(html, '&[a-z]+;')) AS escaped, len(regexp_extract_all(html, 'track\(([0-9]+)\)')) AS calls,
       regexp_extract(html, 'track\(([0-9]+)\)', 1) AS first_call FROM pages
""")
def template_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", count("<script[^>]*>").alias("scripts"), count("&[a-z]+;").alias("escaped"), count(r"track\(([0-9]+)\)").alias("calls"), F.regexp_extract("html", r"track\(([0-9]+)\)", 1).alias("first_call"))


@registered("""
SELECT p_brand AS ruleset, substr(sha256(string_agg(p_type || ':' || p_name, chr(10) ORDER BY p_type || ':' || p_name)), 1, 16) AS hash
FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part) GROUP BY p_brand
""")
def ruleset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select("p_brand", F.concat("p_type", F.lit(":"), "p_name").alias("rule")).distinct()
    joined = F.concat_ws("\n", F.array_sort(F.collect_list("rule")))
    return rules.groupBy(F.col("p_brand").alias("ruleset")).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("hash"))


@registered("""
SELECT o_orderkey, o_orderstatus, split_part(o_orderpriority, '-', 1) AS name, o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' AS authenticated,
       o_orderstatus = 'O' AND NOT (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%') AS finding FROM orders
""")
def route_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middleware compares by the name before its arguments; open routes without a login are findings."""
    name = F.substring_index("o_orderpriority", "-", 1)
    known = name.isin("1", "2")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", name.alias("name"), known.alias("authenticated"), ((F.col("o_orderstatus") == "O") & ~known).alias("finding"))


@registered("""
WITH m AS (SELECT o_orderkey, unnest(string_split(lower(o_orderpriority), ' ')) AS m FROM orders), g(name, member) AS (VALUES ('1-urgent', 'auth'), ('1-urgent', 'throttle'), ('2-high', 'auth'))
SELECT DISTINCT m.o_orderkey, coalesce(g.member, m.m) AS middleware FROM m LEFT JOIN g ON g.name = m.m
""")
def middleware_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group names expand to their members; other names stand for themselves; each counts once a route."""
    g = spark.createDataFrame([("1-urgent", "auth"), ("1-urgent", "throttle"), ("2-high", "auth")], "name string, member string")
    m = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.split(F.lower("o_orderpriority"), " ")).alias("name"))
    return m.join(F.broadcast(g), "name", "left").select("o_orderkey", F.coalesce("member", "name").alias("middleware")).distinct()


@registered("""
WITH s(prefix, root) AS (VALUES ('Customer#0000000', 'app'), ('Customer#000000', 'lib'), ('Customer#', 'src'))
SELECT c_custkey, root FROM (SELECT c_custkey, root, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) AS rn FROM customer JOIN s ON starts_with(c_name, prefix)) WHERE rn = 1
""")
def autoload_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest declared prefix of a class name gives its root."""
    s = spark.createDataFrame([("Customer#0000000", "app"), ("Customer#000000", "lib"), ("Customer#", "src")], "prefix string, root string")
    hit = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(s), F.col("c_name").startswith(F.col("prefix")))
    return hit.groupBy("c_custkey").agg(F.max_by("root", F.length("prefix")).alias("root"))


@registered("""
SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS policy, count(DISTINCT o_orderpriority) AS declared FROM orders GROUP BY o_custkey
""")
def policy_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("policy"), F.countDistinct("o_orderpriority").alias("declared"))


@registered("""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS addresses, len(string_split(coalesce(text, ''), chr(10))) AS lines,
       regexp_matches(coalesce(text, ''), '(?i)(license|copyright)') AS licensed FROM documents
""")
def source_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern rules over whole source texts."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+")).alias("addresses"), F.size(F.split(t, "\n", -1)).alias("lines"), t.rlike("(?i)(license|copyright)").alias("licensed"))
