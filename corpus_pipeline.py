"""A training-data pipeline: toxic documents out, shared lines out, one of each
group of near duplicates, sources mixed to target weights, packed sequences.

Every stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the
last return the columns of ``documents``.  In every stage other columns are left
out, an empty table gives an empty table, and very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import stored
from clientlens.llm.line_dedup import line_dedup
from clientlens.llm.mixing import mix
from clientlens.llm.ngram_join import ngram_components
from clientlens.llm.packing import pack
from clientlens.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go.

    Null and empty texts score as texts without any known feature do; a null
    doc_id is scored like any other; repeated rows go or stay together; a score
    of exactly one half goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that three or more documents share; n_chars follows.

    Null and empty texts are one empty line and stay as they are; rows with a
    null doc_id count as no document and keep their lines; of several rows with
    the largest doc_id that holds a line all keep it.
    """
    n = F.char_length("text").cast("long")
    return line_dedup(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, n).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Rows that repeat an id are one document: of them the smallest text stays.
    Rows without an id stay, since no group can name them.  Texts without words,
    null or empty, are linked with nothing and stay.
    """
    first = ngram_components(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = stored(first, "first-of-group")
    once = docs.join(first.where("n = 1"), "doc_id", "left_semi").select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    again = docs.join(first.where("n > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r"))
    return docs.where("doc_id is null").select(*COLUMNS).union(once).union(again.select("doc_id", "r.*").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all or up to twice.

    A null source is a source of its own, the last; null and empty texts have no
    words, so no share of a target; repeated rows are taken each for itself; ties
    in the rounding go by a hash of id and text.
    """
    return mix(docs).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    A null or empty text is its end mark alone; a null doc_id stays null; every
    copy of a document is packed; texts with one place on the curve go by a hash
    of the id.
    """
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_shared_lines),
    ("near duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs


ORACLE_SQL = None
