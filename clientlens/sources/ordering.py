"""Log files in order of time, without those that a window leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD_LINES = 256


def spans(parsed: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, first, last): the first time among a file's first 256 lines, and the
    time of its last line that has one (null for .gz, which has no cheap end)."""
    first = F.min_by("ts", F.when((F.col(line) < HEAD_LINES) & F.col("ts").isNotNull(), F.col(line)))
    last = F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col(line)))
    g = parsed.groupBy(file).agg(first.alias("first"), last.alias("last"))
    return g.withColumn("last", F.when(F.col("first").isNotNull() & ~F.endswith(F.col(file), F.lit(".gz")), F.col("last")))


def order_files(table: DataFrame, since_seconds: float | None = None, now=None, file: str = "file") -> DataFrame:
    """(file, place, window_start, kept) of :func:`spans`; files without a time lead,
    by name, and always stay.

    The window ends at ``now``, or at the newest time of the files if that is
    None.  A file goes if it ends before the window; a .gz ends where the next
    one begins.  One row a file: the windows here are over that list only.
    """
    order = Window.orderBy(F.col("first").isNotNull(), "first", file)
    d = table.withColumns({"place": F.row_number().over(order), "upper": F.coalesce("last", F.lead("first").over(order))})
    if since_seconds is None:
        return d.select(file, "place", F.lit(None).cast("timestamp").alias("window_start"), F.lit(True).alias("kept"))
    newest = F.max(F.when(F.col("first").isNotNull(), F.coalesce("last", "first"))).over(Window.partitionBy())
    anchor = newest if now is None else F.lit(now).cast("timestamp")
    start = F.timestamp_micros(F.unix_micros(anchor) - int(since_seconds * 1e6))
    timed_out = F.col("first").isNotNull() & F.coalesce(F.col("upper") < start, F.lit(False))
    return d.select(file, "place", start.alias("window_start"), (~timed_out).alias("kept"))
