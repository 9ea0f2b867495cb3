"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import running_sum, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source: ``source, source_size, target, base`` (the words of the sources before it).

    Sources in code point order (null last) take the weights in turn. All sizes together are shared
    by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight. That ends with one level L for which min(weight x L, cap) add up to the whole: sorted by
    cap / weight, the sources before some rank are full and L follows from two running sums. Running sums go over ranges of sources and
    the whole is one row, so sources may be many (hosts).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    placed = running_sum(totals, ["last", "source"], ["one", "source_size"], ["place", "upto"])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = placed.select("source", "last", "source_size", (F.col("upto") - F.col("source_size")).alias("base"), weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    rows = running_sum(rows.withColumn("fullness", F.col("cap") / F.col("w")), ["fullness", "last", "source"], ["cap", "w"], ["cap_upto", "w_upto"])
    rows = written(rows, "sources")
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weights"))
    left = F.col("words") - (F.col("cap_upto") - F.col("cap"))
    level = left.cast("double") / (F.col("weights") - (F.col("w_upto") - F.col("w"))).cast("double")
    fits = rows.crossJoin(F.broadcast(whole)).withColumn("level", level).where(F.col("level") * F.col("w") <= F.col("cap"))
    settled = fits.agg(F.min(F.struct("fullness", "last", "source", "level")).alias("s")).select(F.col("s.level").alias("settled"))
    cap = F.col("cap").cast("double")
    return rows.crossJoin(F.broadcast(settled)).select("source", "source_size", F.least(cap, F.coalesce(F.col("settled") * F.col("w"), cap)).alias("target"), "base")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """Decide how many words the mix takes of every document.

    Documents of a source are shuffled by the MD5 of seed and doc_id; where the target exceeds the source's size the shuffled
    order is gone through again, up to ``most`` times. A copy's virtual finish time is the source's running
    size up to it divided by the source's target. Copies of all sources are range-sorted by virtual
    time (that of their middle, so that errors of rounding are even: finish time less half the
    copy's own share) and the run is cut where the running total passes the budget, the sum of all targets. Copies are
    taken whole, so a source misses its target by about half a document.

    Returns ``doc_id, size, source_size, target, taken`` with one row per input row. Null text and
    empty text have size 0 and are never taken; null sources form one source, the last. Repeated
    rows each count. No rows give no rows. Other columns are ignored.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = sizes.withColumn("shuffled", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # Repeated rows are queued as one row with their number: they are equal in all that counts here.
    rows = sizes.groupBy("source", "shuffled", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows"))
    targets = written(source_targets(sizes, weights, most), "targets")
    summed = running_sum(rows.withColumn("last", F.col("source").isNull()), ["last", "source", "shuffled", "doc_id", "size"], "words", "upto")
    bases = targets.select(F.col("source").alias("s"), "source_size", "target", "base")
    queued = summed.join(bases, summed["source"].eqNullSafe(bases["s"])).drop("s", "last").withColumn("upto", F.col("upto") - F.col("base"))
    rounds = F.least(F.lit(most), F.coalesce(F.ceil(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(1))).cast("int")
    some = queued.where(F.col("size") > 0).withColumn("round", F.explode(F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1)))
    copies = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    finish = F.col("round") * F.col("source_size") + F.col("upto") - (F.col("rows") - F.col("copy")) * F.col("size")
    copies = copies.withColumn("virtual", F.try_divide(finish - F.col("size") / 2, F.col("target")))
    copies = copies.select("source", "doc_id", "size", "copy", "round", "virtual")
    total = running_sum(copies, ["virtual", "source", "doc_id", "size", "copy", "round"], "size", "total")
    budget = targets.agg(F.sum("target").alias("budget"))
    taken = total.crossJoin(F.broadcast(budget)).where(F.col("total") - F.col("size") / 2 <= F.col("budget") + 1e-6)
    taken = taken.groupBy("source", "doc_id", "size", "copy").agg(F.sum("size").alias("taken"))
    keys = ["source", "doc_id", "size"]
    every = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    taken = taken.select(*[F.col(k).alias(f"t_{k}") for k in [*keys, "copy"]], "taken")
    same = every["copy"] == taken["t_copy"]
    for k in keys:
        same = same & every[k].eqNullSafe(taken[f"t_{k}"])
    return every.join(taken, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB. The level is found by trying each source as the first that is not full.
SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM totals),
ordered AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS r FROM weighed),
levels AS (SELECT a.r, a.w, a.cap, (CAST((SELECT sum(source_size) FROM ordered) - coalesce((SELECT sum(cap) FROM ordered b WHERE b.r < a.r), 0) AS DOUBLE))
           / CAST((SELECT sum(w) FROM ordered) - coalesce((SELECT sum(w) FROM ordered b WHERE b.r < a.r), 0) AS DOUBLE) AS level FROM ordered a),
settled AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY r LIMIT 1),
targets AS (SELECT o.source, o.source_size, least(CAST(o.cap AS DOUBLE), s.level * o.w) AS target FROM ordered o, settled s),
shuffled AS (SELECT s.*, t.source_size, t.target, md5('mix' || CAST(s.doc_id AS VARCHAR)) AS h FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM shuffled),
copies AS (SELECT source, doc_id, size, k, (k * source_size + upto - size / 2) / target AS virtual
           FROM summed, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND k < greatest(least(3, ceil(target / source_size)), 1)),
run AS (SELECT *, sum(size) OVER (ORDER BY virtual, source NULLS FIRST, doc_id, size, k ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT source, doc_id, sum(size) AS taken FROM run WHERE total - size / 2 <= (SELECT sum(target) FROM targets) + 1e-6 GROUP BY source, doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM shuffled s LEFT JOIN taken t ON s.doc_id = t.doc_id AND s.source IS NOT DISTINCT FROM t.source
"""
