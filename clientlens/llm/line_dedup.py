"""Line dedup: drop lines that many documents share, keep one holder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import SPACE, lower_ascii, row_key, stored

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of ``docs`` with its text rebuilt without shared lines.

    Lines are cut at ``\\n``; a key of at least ``min_chars`` code points found in
    at least ``min_docs`` distinct documents loses all its lines except those of
    the largest doc_id holding it.  Adds n_lines, n_dropped and keeps all columns.

    Defined cases: a null or empty text is one empty line and stays; a null
    doc_id counts as no document and never holds a key; rows that repeat a doc_id
    are that document's lines too; an empty table gives an empty table; an input
    column named n_lines or n_dropped is replaced.

    Plan: one exchange of (hash, doc_id) pairs, partially aggregated, then by
    hash; the kept text crosses one exchange by row key.  Lines too short to be
    dropped never leave their row.  A hot line is one partial count per task.
    """
    d = docs.drop("n_lines", "n_dropped").withColumn("_rk", row_key())
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cand = (
        d.select("_rk", F.col("doc_id").alias("_d"), F.posexplode(lines).alias("_p", "_l"))
        .withColumn("_k", line_key(F.col("_l")))
        .where(F.char_length("_k") >= min_chars)
        .select("_rk", "_d", "_p", F.unhex(F.md5("_k")).alias("_h"))
    )
    shared = (
        cand.groupBy("_h", "_d").agg(F.lit(1).alias("one"))
        .groupBy("_h").agg(F.count("_d").alias("_n"), F.max("_d").alias("_keep"))
        .where(F.col("_n") >= min_docs)
        .select("_h", "_keep")
    )
    shared = stored(shared, "shared-lines")  # a written side: Spark can split a hot line's rows, or broadcast it if small
    dropped = (
        cand.join(shared, "_h")
        .where(F.col("_d").isNull() | (F.col("_d") != F.col("_keep")))
        .groupBy("_rk").agg(F.collect_set("_p").alias("_drop"))
    )
    j = d.join(dropped, "_rk", "left").withColumn("_lines", lines)
    n, cut = F.size("_lines"), F.size(F.coalesce("_drop", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")
    )
    return j.select(
        *[text.alias(c) if c == "text" else c for c in docs.columns if c not in ("n_lines", "n_dropped")],
        n.cast("long").alias("n_lines"),
        cut.cast("long").alias("n_dropped"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, p, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
bad AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT l.doc_id, l.p, l.line, (bad.k IS NOT NULL AND l.doc_id <> bad.keep) AS dropped
  FROM l LEFT JOIN bad ON l.k = bad.k)
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
