"""Folders that driver and executors share, and tables kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.  Without that setting a folder
    below /tmp serves one process (tests); on a cluster it is an error, since each
    executor would write to a disk of its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_census_base", None)
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = sc._census_base = f"file:///tmp/spark-census-{uuid.uuid4().hex}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The JVM leaves longer methods uncompiled; a stage that needs one runs by operators.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: several readers of it
    cost one computation, and its lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    conf, (setting, limit) = df.sparkSession.conf, METHOD_LIMIT
    was = conf.get(setting)
    conf.set(setting, limit)
    try:
        df.write.parquet(path)
    finally:
        conf.set(setting, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)
