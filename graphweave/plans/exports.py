"""Export and history queries: the whole graph in total order as JSON and GraphML lines, and graphs stored, replaced and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.identity import digest16, node_id
from graphweave.operators.ranking import first_of
from graphweave.operators.scratch import numbered, shared_folder
from graphweave.operators.store import Store, insert_if_absent, ordered
from graphweave.plans.graph import _EDGES, _NODES
from graphweave.sources.driver_tables import edges, nodes, table

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _edge_ids(e: DataFrame) -> DataFrame:
    """Edges by the ids of their ends, computed in place: an id is a digest of kind and key."""
    return e.select(node_id(F.col("src_kind"), F.col("src")).alias("src_id"), node_id(F.col("dst_kind"), F.col("dst")).alias("dst_id"), "kind", "conf")


_IDS = "substr(sha1(concat_ws('|', '1', {0}_kind, CAST({0} AS VARCHAR), '')), 1, 16)"
_LINKS = f"SELECT {_IDS.format('src')} AS src_id, {_IDS.format('dst')} AS dst_id, kind, CAST(conf AS INTEGER) AS conf FROM ({_EDGES})"


@registered(f"""
WITH n AS ({_NODES}), e AS ({_LINKS})
SELECT 'node' AS section, row_number() OVER (ORDER BY kind, name, id) AS place, '{{"id":"' || id || '","kind":"' || kind || '","key":' || key || ',"fqn":"' || name || '"' || CASE WHEN key % 2 = 0 THEN ',"even":true' ELSE '' END || '}}' AS line FROM n
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY src_id, dst_id, kind, conf), '{{"src":"' || src_id || '","dst":"' || dst_id || '","kind":"' || kind || '","confidence":' || conf || '}}' FROM e
""")
def graph_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes by (kind, name, id) and all edges by every field as numbered JSON lines; a null attribute leaves its key out.

    The numbers come from a range sort and the counts of its ranges, so no task sees all rows.
    """
    n = numbered(nodes(spark, sf_dir), ["kind", "name", "id"])
    body = F.to_json(F.struct("id", "kind", "key", F.col("name").alias("fqn"), F.when(F.col("key") % 2 == 0, True).alias("even")))
    e = numbered(_edge_ids(edges(spark, sf_dir)), ["src_id", "dst_id", "kind", "conf"])
    link = F.to_json(F.struct(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", F.col("conf").alias("confidence")))
    return n.select(F.lit("node").alias("section"), "place", body.alias("line")).unionByName(e.select(F.lit("edge").alias("section"), "place", link.alias("line")))


@registered(f"""
WITH n AS ({_NODES}), e AS ({_LINKS})
SELECT 'node' AS section, row_number() OVER (ORDER BY kind, name, id) AS place, '<node id="' || id || '"><data key="kind">' || kind || '</data><data key="fqn">' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></node>' AS line FROM n
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY src_id, dst_id, kind, conf), '<edge source="' || src_id || '" target="' || dst_id || '"><data key="kind">' || kind || '</data><data key="confidence">' || conf || '</data></edge>' FROM e
""")
def graph_export_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export as GraphML elements, with text escaped; an absent name leaves its element out."""
    name = F.replace(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = numbered(nodes(spark, sf_dir), ["kind", "name", "id"])
    node = F.concat(F.lit('<node id="'), "id", F.lit('"><data key="kind">'), "kind", F.lit("</data>"), F.coalesce(F.concat(F.lit('<data key="fqn">'), name, F.lit("</data>")), F.lit("")), F.lit("</node>"))
    e = numbered(_edge_ids(edges(spark, sf_dir)), ["src_id", "dst_id", "kind", "conf"])
    edge = F.concat(F.lit('<edge source="'), "src_id", F.lit('" target="'), "dst_id", F.lit('"><data key="kind">'), "kind", F.lit('</data><data key="confidence">'), F.col("conf").cast("string"), F.lit("</data></edge>"))
    return n.select(F.lit("node").alias("section"), "place", node.alias("line")).unionByName(e.select(F.lit("edge").alias("section"), "place", edge.alias("line")))


@registered(f"""
WITH e AS ({_LINKS}), n AS (SELECT id, kind, key, CASE WHEN kind = 'part' THEN 1 WHEN kind = 'order' THEN 2 ELSE 1 END AS first_scan FROM ({_NODES}))
SELECT 'node' AS section, id AS a, kind AS b, CAST(key AS VARCHAR) AS c, first_scan AS v FROM n
UNION ALL SELECT 'edge', src_id, dst_id, kind, CASE WHEN kind = 'CALLS' THEN conf - 1 ELSE conf END FROM e
""")
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans stored and read back: nodes are inserted if absent and keep the scan that saw them first, edges are stored in parts by kind, and the second scan writes only the kinds it replaces.

    The first scan sees no orders and no edges of theirs but CALLS; the second sees everything, with calls less sure by one.
    """
    store = Store(spark, f"{shared_folder(spark)}/graphweave-store-{uuid.uuid4().hex}")
    n, e = nodes(spark, sf_dir).drop("name"), _edge_ids(edges(spark, sf_dir))
    store.commit(nodes=insert_if_absent(None, n.where("kind <> 'order'").withColumn("first_scan", F.lit(1)), ["id"], ["kind", "key"]), parts={"edges": (e.where("kind <> 'HANDLES'"), ["kind"])})
    later = e.where("kind IN ('CALLS', 'HANDLES')").withColumn("conf", F.when(F.col("kind") == "CALLS", F.col("conf") - 1).otherwise(F.col("conf")).cast("int"))
    seen = insert_if_absent(store.read("nodes"), n.withColumn("first_scan", F.lit(2)), ["id"], ["kind", "key"])
    store.commit(nodes=seen, parts={"edges": (later, ["kind"])})
    back = store.read("nodes").orderBy("id").select(F.lit("node").alias("section"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("key").cast("string").alias("c"), F.col("first_scan").alias("v"))
    links = ordered(store.read("edges")).select(F.lit("edge").alias("section"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.col("kind").alias("c"), F.col("conf").alias("v"))
    return back.unionByName(links)


@registered("""
WITH p AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS scan FROM events),
f AS (SELECT scan, substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))), 1, 16) AS fingerprint, k % 5 AS rank, min(event_id) AS first_event, count(*) AS steps FROM p WHERE k >= 5 GROUP BY 1, 2, 3)
SELECT scan, fingerprint, rank, first_event, steps, CAST(min(scan) OVER (PARTITION BY fingerprint, rank) AS INTEGER) AS first_seen FROM f
""")
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every scan in stored order (scan, rank, first event, fingerprint) with the scan that saw each first; repeated rows of a scan count as its steps."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    scan = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    f = e.where(k >= 5).groupBy(scan.alias("scan"), digest16(F.col("event_type"), F.col("user_id")).alias("fingerprint"), (k % 5).alias("rank")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("steps"))
    first = f.groupBy("fingerprint", "rank").agg(F.min("scan").alias("first_seen"))
    return f.join(first, ["fingerprint", "rank"]).select("scan", "fingerprint", "rank", "first_event", "steps", "first_seen").orderBy("scan", F.desc("rank"), "first_event", "fingerprint")


@registered("""
WITH c AS (SELECT event_type AS rule, count(DISTINCT user_id) AS found FROM events WHERE event_id % 7 = 0 GROUP BY event_type),
f AS (SELECT event_type AS rule, user_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS rn FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 7 = 0))
SELECT f.rule, f.user_id, CAST(f.rn AS INTEGER) AS rn, c.found - least(5, c.found) AS more FROM f JOIN c ON c.rule = f.rule WHERE f.rn <= 5
""")
def capped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five findings of each rule for display and the number that is left out."""
    f = table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_type").alias("rule"), "user_id").distinct()
    found = f.groupBy("rule").agg(F.count("*").alias("found"))
    shown = first_of(f, ["rule"], [F.col("user_id")], 5)
    return shown.join(found, "rule").select("rule", "user_id", "rn", (F.col("found") - F.least(F.lit(5), F.col("found"))).alias("more"))
