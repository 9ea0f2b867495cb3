"""Training-data pipeline over ``documents``: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import bpe, line_dedup, mixing, simhash, toxicity
from graphweave.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is fitted on ``documents`` and ``labels``. Null and empty texts stay, and without labels all do."""
    return toxicity.score(docs, toxicity.fit_on_tables(spark, sf_dir)).where(~F.col("rejected")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three consecutive lines go from the texts; ``n_chars`` follows. No document goes."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies (five-word shingles, similarity 0.8) the document of least doc_id stays."""
    return simhash.dedup_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times. Rows that share doc_id and source share its copies evenly."""
    takes = mixing.mix(docs).groupBy("doc_id", "source").agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("_gw_times")).where("_gw_times > 0")
    takes = takes.select(F.col("doc_id").alias("_gw_id"), F.col("source").alias("_gw_source"), "_gw_times")
    joined = docs.join(takes, docs["doc_id"].eqNullSafe(takes["_gw_id"]) & docs["source"].eqNullSafe(takes["_gw_source"]))
    return joined.withColumn("_gw_copy", F.explode(F.sequence(F.lit(1), F.col("_gw_times")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and of the bytes they decode to. Null text counts as empty: no ids."""
    path, pattern = bpe.tokenizer()
    decoded = bpe.decode(bpe.encode(docs, path, pattern), path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Trained models and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
