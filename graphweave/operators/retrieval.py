"""Hybrid retrieval: words by BM25 over an inverted index, vectors by cosine, both within a metadata filter, fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings of one term, and vectors of one group, that meet the queries in one task.
HOT = 20_000
K1, B, UNIT, RRF = 1.2, 0.75, 1_000_000, 60
TERMS = r"[\p{L}\p{N}]+"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERMS), F.lit(0))


def _first(scored: DataFrame, k: int) -> DataFrame:
    """``item, doc, rank``: the ``k`` of greatest ``score`` of every item, ties to the lesser doc; Spark keeps k a task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("item", "doc", "rank")


def word_ranks(docs: DataFrame, queries: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """``item, doc, rank``: the ``k`` best of ``docs`` (``doc, part, text``) of a query's own ``part`` for each of ``queries`` (``item, part, text``) by BM25 over its distinct terms.

    Statistics (documents, lengths, documents of a term) are those of all docs; postings are kept for terms of queries only. Scores add up whole millionths, so order does not
    matter. Postings of a term that more than ``hot`` docs hold are spread by salt and its queries sent to every salt. Null texts have no terms; a document without any of the terms is not ranked.
    """
    asked = queries.select("item", "part", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    held = docs.select("doc", "part", _terms(F.col("text")).alias("terms"))
    whole = held.where(F.size("terms") > 0).agg(F.count("*").alias("docs"), F.avg(F.size("terms")).alias("mean"))
    words = held.select("doc", "part", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("doc", "part", "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("salts", F.ceil(F.col("df") / hot).cast("int"))
    # One row, the counts of all documents.
    post = tf.join(df, "term").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.floor(UNIT * (idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))))
    post = post.select("term", "part", "doc", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), score.alias("score"))
    sent = asked.join(df.select("term", "salts"), "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = post.join(sent, ["term", "part", "salt"])
    return _first(met.groupBy("item", "doc").agg(F.sum("score").alias("score")), k)


def _usable(rows: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.where("embedding IS NOT NULL").where(fine).withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_ranks(docs: DataFrame, queries: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """``item, doc, rank``: the ``k`` nearest of ``docs`` (``doc, part, embedding``) of a query's own ``part`` by cosine (nine places), never the query's own id.

    A part of more than ``hot`` vectors is spread by salt and its queries sent to every salt. Vectors that are null, zero, not finite or of another length take no part.
    """
    rows = _usable(docs.select("doc", "part", "embedding"))
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts"))
    rows = rows.join(sizes, "part").select("part", "doc", "embedding", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("norm"), F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"))
    asked = _usable(queries.select("item", "part", "embedding")).join(sizes, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = asked.select("item", "part", "salt", F.col("embedding").alias("q"), F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("q_norm"))
    met = rows.join(asked, ["part", "salt"]).where((F.size("q") == F.size("embedding")) & (F.col("item") != F.col("doc")))
    return _first(met.select("item", "doc", F.round(_dot(F.col("q"), F.col("embedding")) / (F.col("q_norm") * F.col("norm")), 9).alias("score")), k)


def fused(by_words: DataFrame, by_vectors: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """``item, rank, doc, word_rank, vector_rank, score``: the ``k`` of greatest sum of reciprocal ranks; what one list lacks counts by the other."""
    both = by_words.withColumnRenamed("rank", "word_rank").join(by_vectors.withColumnRenamed("rank", "vector_rank"), ["item", "doc"], "full")
    share = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    rows = both.withColumn("score", F.round(share("word_rank") + share("vector_rank"), 9))
    return _first(rows, k).join(rows, ["item", "doc"]).select("item", "rank", "doc", "word_rank", "vector_rank", "score")
