"""Tables kept in the shared folder leave nothing else on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from clientlens.llm.common import CLEAN_UP, stored


def _shuffled(spark) -> set[str]:
    base = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    return {f.name for f in base.rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    was, before = spark.conf.get(CLEAN_UP), _shuffled(spark)
    out = stored(spark.range(20_000).repartition(3, F.col("id") % 7), "once")
    for _ in range(50):  # executors remove them on their own
        if _shuffled(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffled(spark) <= before and out.count() == 20_000 and spark.conf.get(CLEAN_UP) == was
