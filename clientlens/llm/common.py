"""Pieces that several operators share: row keys, shared folders, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line definitions: space and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; every other letter stays."""
    return F.translate(c, UPPER, LOWER)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 16-byte key of a row's id and text, so that joins neither lose rows
    whose id is null nor mix up different texts under one id."""
    return F.unhex(
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))
    )


def with_rows(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*names)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors and driver share.

    Only where that setting is absent and all of Spark runs in one process (tests)
    a folder below /tmp is taken and set as the checkpoint folder; on a cluster a
    missing setting is an error, since executors share no local folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_llm_base", None)
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = sc._llm_base = f"file:///tmp/spark-llm-{uuid.uuid4().hex}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Files of a shuffle go with the query that made them; else they stay until the
#: driver happens to collect its garbage, and a long run holds those of all its steps.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage
    ends here, and a lost executor costs nothing that was written.  What was
    shuffled for it is removed once it is written."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, was)
    return spark.read.schema(df.schema).parquet(path)


_STORE: dict = {}


def worker_store(name: str, make):
    """What an operator keeps in a Python worker from task to task.  Workers outlive
    operators, so a worker has one store: that of the operator it served last."""
    if name not in _STORE:
        _STORE.clear()
        _STORE[name] = make()
    return _STORE[name]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over undirected ``edges``.

    Minimum-label propagation with pointer jumping; each round is joins and
    partial minima on the cluster, written to the shared folder.  Only a count of
    changed labels comes to the driver.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = stored(e.union(e.select(F.col("v"), F.col("u"))).distinct(), "edges")
    lab = stored(
        e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels"
    )
    while True:
        near = (
            e.join(lab.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        step = lab.join(near, "node").select("node", F.least("component", "c").alias("next"), F.col("component").alias("was"))
        # pointer jump: the label of my label
        jump = step.join(
            lab.select(F.col("node").alias("next"), F.col("component").alias("jumped")), "next", "left"
        ).select("node", F.least("next", F.coalesce("jumped", "next")).alias("component"), "was")
        out = stored(jump, "labels")
        moved = out.where("component <> was").limit(1).count()
        lab = out.select("node", "component")
        if not moved:
            return lab
