"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import written

WINDOW = 3


def _kept(lines: Column, covered: Column) -> Column:
    """``lines`` without the positions in ``covered``; linear in the number of lines.

    The inner functions would split the text again for every line; as the argument of an outer one it is split once.
    """

    def left(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), covered)
        return F.array_join(F.transform(kept, lambda i: F.element_at(own, i + 1)), "\n")

    return F.element_at(F.transform(F.array(lines), left), 1)


def window_occurrences(docs: DataFrame) -> DataFrame:
    """One row per document and three-line window: ``doc_id, copy, pos, h1, h2``.

    ``copy`` is a hash of the text, which tells rows that share a doc_id apart. Two 64-bit hashes
    with different seeds stand for a window.
    """
    lines = F.split("text", "\n", -1)
    at = F.sequence(F.lit(0), F.size("lines") - WINDOW)

    def window(i: Column) -> Column:
        three = [F.element_at("lines", i + k) for k in range(1, WINDOW + 1)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2"))

    cut = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("copy"), lines.alias("lines"))
    cut = cut.where(F.size("lines") >= WINDOW)
    return cut.select("doc_id", "copy", F.posexplode(F.transform(at, window)).alias("pos", "w")).select("doc_id", "copy", "pos", "w.h1", "w.h2")


def covered_positions(docs: DataFrame) -> DataFrame:
    """Per document with something to remove: ``doc_id, copy, covered`` (line positions from 0)."""
    occurrences = written(window_occurrences(docs), "windows")
    place = F.struct("doc_id", "copy", "pos")
    repeated = occurrences.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = repeated.where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    later = occurrences.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    merged = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.array(*[p + k for k in range(WINDOW)]))))
    return later.groupBy("doc_id", "copy").agg(merged.alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove every later occurrence of three consecutive lines that occur anywhere before.

    Lines end at ``\\n`` and compare exactly. Occurrences are ordered by doc_id (null first), then by
    position; the first stays, and in every later one all three lines go. Returns the rows of ``docs``
    with all their columns, ``text`` replaced, plus ``n_lines`` and ``n_removed``.

    Null text stays null with 0 lines; empty text is one empty line. Texts under three lines have no
    window and stay whole. Rows that agree in doc_id and text count as one occurrence, so they
    come out alike. A text that loses all its lines becomes empty; its row stays. Extra columns pass
    through; columns named ``n_lines``, ``n_removed`` or ``_gw_*`` are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed") and not c.startswith("_gw_")]
    covered = covered_positions(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_gw_id"), F.col("copy").alias("_gw_copy"), F.col("covered").alias("_gw_covered"))
    keyed = docs.select(*own).withColumn("_gw_key", F.xxhash64("text"))
    joined = keyed.join(covered, keyed["doc_id"].eqNullSafe(covered["_gw_id"]) & (keyed["_gw_key"] == covered["_gw_copy"]), "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.size("_gw_covered"), F.lit(0))
    text = F.when(F.col("_gw_covered").isNull(), F.col("text")).otherwise(_kept(lines, F.col("_gw_covered")))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    out = joined.withColumn("n_lines", count.cast("long")).withColumn("n_removed", F.when(F.col("_gw_covered").isNull(), 0).otherwise(gone).cast("long"))
    return out.withColumn("text", text).select(*own, "n_lines", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


#: The same rows in DuckDB; windows compare by their text.
SQL = """
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS pos FROM lined WHERE len(lines) >= 3),
windows AS (SELECT doc_id, text, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w FROM starts),
ranked AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows),
later AS (SELECT DISTINCT doc_id, text, pos + d AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
numbered AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM lined),
kept AS (SELECT n.doc_id, n.text, string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE l.pos IS NULL) AS kept, count(*) AS n_lines, count(l.pos) AS n_removed
         FROM numbered n LEFT JOIN later l ON n.doc_id = l.doc_id AND n.text = l.text AND n.pos = l.pos GROUP BY n.doc_id, n.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
