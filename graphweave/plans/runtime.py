"""Queries beside the code graph: runtime events by stream, hybrid retrieval, near names, secrets. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.secrets import CONTEXT, DIGITS, ENTROPY, SAYS, TOKEN, check_digit, entropy, spans
from graphweave.operators import retrieval
from graphweave.operators.names import near_names
from graphweave.sources.driver_tables import table
from graphweave.streaming.runtime import anomalies, drained, event_stream, windowed

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_UNTIL = "2024-01-20 00:00:00"


@registered(f"""
WITH c AS (SELECT time_bucket(INTERVAL '6 hours', CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') AS start, c_mktsegment AS route, event_type AS kind, count(*) AS seen, sum(value) AS total
  FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2, 3),
b AS (SELECT route, kind, count(*) AS windows, avg(seen) AS mean, stddev_pop(seen) AS deviation FROM c WHERE start < TIMESTAMP '{_UNTIL}' GROUP BY route, kind),
w AS (SELECT start, sum(seen) AS n FROM c GROUP BY start)
SELECT c.start, c.route, c.kind, c.seen, round(c.total, 6) AS total, CASE WHEN b.windows > 1 AND b.deviation > 0 THEN round((c.seen - b.mean) / b.deviation, 6) END AS score, round(c.seen / w.n, 6) AS share
FROM c JOIN w ON w.start = c.start LEFT JOIN b ON b.route IS NOT DISTINCT FROM c.route AND b.kind = c.kind WHERE c.start >= TIMESTAMP '{_UNTIL}'
""")
def runtime_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by stream against the routes of the users that sent them: six-hour counts per route and kind of event, scored against the windows before a day."""
    routes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("route"))
    events = event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), "value")
    counts = drained(windowed(events, routes, "user_id", ["route", "kind"], "6 hours", "1 day"), ["start", "route", "kind"])
    scored = anomalies(counts, ["route", "kind"], F.lit(_UNTIL).cast("timestamp"))
    return scored.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 6))


_LISTED, _SHOWN = 50, 4
_VECTOR = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _terms(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '{retrieval.TERMS}')"


@registered(f"""
WITH d AS (SELECT doc_id AS doc, label AS part, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT item_id AS item, label AS part, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
held AS (SELECT doc, part, {_terms('text')} AS terms FROM d), whole AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM held WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item, part, unnest({_terms('text')}) AS term FROM q),
tf AS (SELECT doc, part, n, term, count(*) AS tf FROM (SELECT doc, part, len(terms) AS n, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY doc, part, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
p AS (SELECT tf.term, tf.part, doc, CAST(floor(1000000 * (ln(1 + (docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (tf * CAST({retrieval.K1 + 1} AS DOUBLE)) / (tf + CAST({retrieval.K1} AS DOUBLE) * (CAST({1 - retrieval.B} AS DOUBLE) + CAST({retrieval.B} AS DOUBLE) * n / mean)))) AS BIGINT) AS score FROM tf JOIN df ON df.term = tf.term, whole),
w AS (SELECT item, doc, sum(score) AS score FROM p JOIN asked a ON a.term = p.term AND a.part = p.part GROUP BY item, doc),
wr AS (SELECT item, doc, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc) AS rank FROM w),
v AS (SELECT q.item, d.doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))), 9) AS score
  FROM (SELECT * FROM q WHERE {_VECTOR}) q JOIN (SELECT * FROM d WHERE {_VECTOR}) d ON d.part = q.part AND d.doc <> q.item AND len(d.embedding) = len(q.embedding)),
vr AS (SELECT item, doc, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc) AS rank FROM v),
f AS (SELECT coalesce(a.item, b.item) AS item, coalesce(a.doc, b.doc) AS doc, a.rank AS word_rank, b.rank AS vector_rank, round(coalesce(CAST(1 AS DOUBLE) / (60 + a.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM wr WHERE rank <= {_LISTED}) a FULL JOIN (SELECT * FROM vr WHERE rank <= {_LISTED}) b ON a.item = b.item AND a.doc = b.doc)
SELECT item, CAST(rank AS INTEGER) AS rank, doc, CAST(word_rank AS INTEGER) AS word_rank, CAST(vector_rank AS INTEGER) AS vector_rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= {_SHOWN}
""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best documents for each question: those of the question's own label, the fifty best by words and by vectors, fused by reciprocal ranks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("part"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").join(vectors.withColumnRenamed("vec_id", "doc"), "doc")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text").join(vectors.withColumnRenamed("vec_id", "item"), "item")
    return retrieval.fused(retrieval.word_ranks(docs, questions, _LISTED), retrieval.vector_ranks(docs, questions, _LISTED), _SHOWN)


_HOST = r"^[a-z]+://(?:m\.|blog\.|www\.)?([^/.]+)\."


@registered(f"""
WITH n AS (SELECT regexp_extract(url, '{_HOST}', 1) AS name, count(*) AS pages FROM pages WHERE regexp_matches(url, '{_HOST}') GROUP BY 1)
SELECT a.name, b.name AS other, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance, a.pages, b.pages AS other_pages FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 2
""")
def near_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose names a slip of two letters turns into each other, with the pages of each."""
    hosts = table(spark, sf_dir, "pages").where(F.col("url").rlike(_HOST)).groupBy(F.regexp_extract("url", _HOST, 1).alias("name")).agg(F.count("*").alias("pages"))
    other = hosts.toDF("other", "other_pages")
    return near_names(hosts).join(hosts, "name").join(other, "other").select("name", "other", "distance", "pages", "other_pages")


@registered(f"""
WITH t AS (SELECT doc_id, 'token' AS kind, regexp_extract_all(text, '{TOKEN}') AS found, regexp_split_to_array(text, '{TOKEN}') AS between FROM documents
  UNION ALL SELECT doc_id, 'number', regexp_extract_all(text, '{DIGITS}'), regexp_split_to_array(text, '{DIGITS}') FROM documents),
u AS (SELECT doc_id, kind, unnest(range(1, len(found) + 1)) AS nth, found, between FROM t),
c AS (SELECT doc_id, kind, CAST(nth AS INTEGER) AS nth, CASE kind WHEN 'token' THEN found[nth] ELSE replace(replace(found[nth], ' ', ''), '-', '') END AS value, lower(right(between[nth], {CONTEXT})) AS context FROM u),
x AS (SELECT *, round(list_sum(list_transform(list_sort(list_distinct(string_split(value, ''))), lambda l: -(len(list_filter(string_split(value, ''), lambda y: y = l)) / CAST(length(value) AS DOUBLE)) * log2(len(list_filter(string_split(value, ''), lambda y: y = l)) / CAST(length(value) AS DOUBLE)))), 6) AS entropy,
  regexp_matches(context, '{SAYS}') AS named, CASE WHEN kind = 'number' THEN length(value) BETWEEN 13 AND 19 AND CAST(list_sum(list_transform(range(0, length(value)),
    lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(value, length(value) - i, 1) AS INTEGER) ELSE 2 * CAST(substr(value, length(value) - i, 1) AS INTEGER) - CASE WHEN CAST(substr(value, length(value) - i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) AS INTEGER) % 10 = 0 END AS checks FROM c)
SELECT doc_id, kind, nth, CAST(length(value) AS INTEGER) AS length, sha256(value) AS digest, entropy, named, checks, CASE kind WHEN 'token' THEN entropy >= {ENTROPY} AND named ELSE checks AND entropy > 0 END AS secret FROM x
""")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every whole text, by digest: runs that look like keys are secrets if their entropy is high and the words before them say so, numbers if their check digit fits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    token, number = spans(F.col("text"), TOKEN), spans(F.col("text"), DIGITS)
    kinds = F.array(F.struct(F.lit("token").alias("kind"), token.alias("spans")), F.struct(F.lit("number").alias("kind"), number.alias("spans")))
    rows = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.posexplode("k.spans").alias("at", "s"))
    is_token = F.col("kind") == "token"
    value = F.when(is_token, F.col("s.value")).otherwise(F.regexp_replace("s.value", "[ -]", ""))
    rows = rows.select("doc_id", "kind", (F.col("at") + 1).alias("nth"), value.alias("value"), F.col("s.context").alias("context"))
    checks = F.when(~is_token, F.length("value").between(13, 19) & check_digit(F.col("value")))
    rows = rows.select("doc_id", "kind", "nth", F.length("value").alias("length"), F.sha2("value", 256).alias("digest"), entropy(F.col("value")).alias("entropy"), F.col("context").rlike(SAYS).alias("named"), checks.alias("checks"))
    return rows.withColumn("secret", F.when(is_token, (F.col("entropy") >= ENTROPY) & F.col("named")).otherwise(F.col("checks") & (F.col("entropy") > 0)))
