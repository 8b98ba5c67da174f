"""Intervals of addresses: minimal sets, flattening by rank, and a sorted-range join.

Keys are strings that sort as their addresses do (32 hexadecimal digits, both
versions), so nothing here is cut into blocks and no prefix is a hot key.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.sources.shared import kept

#: Intervals that one task flattens, and up to which a table is sent to every task.
SLICE, SMALL = 50_000, 100_000
DIGITS = 32
SEGMENT = "lo string, hi string, rank int, name string"


def successor(key: Column) -> Column:
    """The next key; null after the last one."""
    tail = F.length(F.regexp_extract(key, "f*$", 0))
    at = F.lit(DIGITS) - tail
    next_digit = F.translate(F.substring(key, at, F.lit(1)), "0123456789abcde", "123456789abcdef")
    return F.when(at > 0, F.concat(F.substring(key, F.lit(1), at - 1), next_digit, F.repeat(F.lit("0"), tail)))


def merged(intervals: DataFrame, *by: str) -> DataFrame:
    """(by, lo, hi): the fewest intervals that cover the same keys, those of each
    ``by`` for themselves; touching ones are joined.  Intervals that end before
    they begin, or without a bound, are left out."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    d = intervals.where("lo <= hi").select(*by, "lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the island of an interval begins where it lies beyond the reach of all before
    fresh = reach.isNull() | (F.col("lo") > F.coalesce(successor(reach), F.col("lo")))
    d = d.withColumn("_fresh", fresh.cast("int")).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def flatten(pieces: list[tuple]) -> list[list]:
    """[lo, hi, rank, name] without overlap from such rows with numbers as bounds: at
    every place the smallest (rank, name) of all that cover it."""
    # as Spark orders structs: a missing rank or name comes first
    place = lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")
    pieces = sorted(pieces, key=lambda r: r[0])
    cuts = sorted({x for lo, hi, *_ in pieces for x in (lo, hi + 1)})
    heap: list[tuple] = []
    out: list[list] = []
    i = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        while i < len(pieces) and pieces[i][0] <= a:
            heapq.heappush(heap, (place(pieces[i]), pieces[i][1], i))
            i += 1
        while heap and heap[0][1] < a:
            heapq.heappop(heap)
        if heap:
            rank, name = pieces[heap[0][2]][2:4]
            if out and out[-1][1] == a - 1 and out[-1][2:] == [rank, name]:
                out[-1][1] = b - 1
            else:
                out.append([a, b - 1, rank, name])
    return out


def _hex(n: int) -> str:
    return f"{n:0{DIGITS}x}"


def _segments(rows: list[list]) -> pa.RecordBatch:
    lo, hi, rank, name = zip(*rows, strict=True) if rows else ((), (), (), ())
    cols = [pa.array(map(_hex, lo), pa.string()), pa.array(map(_hex, hi), pa.string()), pa.array(rank, pa.int32()), pa.array(name, pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["lo", "hi", "rank", "name"])


def disjoint(ranges: DataFrame, per_slice: int = SLICE) -> DataFrame:
    """(lo, hi, rank, name) without overlap: at every key the range with the smallest
    rank (then name) of all that hold it.

    The key space is cut into slices of about ``per_slice`` ranges.  A range is
    clipped to each slice it meets; of those that cover a slice whole only the
    first in rank is sent there, so what crosses borders is one row a slice.
    """
    once = ranges.where("lo <= hi").groupBy("lo", "hi").agg(F.min(F.struct("rank", "name")).alias("f"))
    once = kept(once.select("lo", "hi", F.col("f.rank").cast("int").alias("rank"), "f.name"), "ranges")
    parts = max(1, -(-once.count() // per_slice))
    cut = once.repartitionByRange(parts, "lo").groupBy(F.spark_partition_id().alias("p")).agg(F.min("lo").alias("lo"))
    borders = sorted(r.lo for r in cut.collect())[1:] if parts > 1 else []  # one key a slice

    def clip(batches: Iterator[pa.RecordBatch]):
        edge = ["", *borders, None]
        for batch in batches:
            rows = []
            for lo, hi, rank, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last = bisect_right(borders, lo), bisect_right(borders, hi)
                for s in range(first, last + 1):
                    a = lo if s == first else edge[s]
                    b = hi if s == last else _hex(int(edge[s + 1], 16) - 1)
                    rows.append((s, a, b, rank, name, first < s < last))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slice", "lo", "hi", "rank", "name", "whole"])

    pieces = once.select("lo", "hi", "rank", "name").mapInArrow(clip, f"slice int, {SEGMENT}, whole boolean")
    over = pieces.where("whole").groupBy("slice", "lo", "hi").agg(F.min(F.struct("rank", "name")).alias("f")).select("slice", "lo", "hi", "f.rank", "f.name")
    pieces = pieces.where("not whole").drop("whole").unionByName(over)

    def sweep(piece):
        rows = [(int(lo, 16), int(hi, 16), r, n) for lo, hi, r, n in zip(*(piece.column(c).to_pylist() for c in ("lo", "hi", "rank", "name")), strict=True)]
        return pa.Table.from_batches([_segments(flatten(rows))])

    return pieces.groupBy("slice").applyInArrow(sweep, SEGMENT)


def locate(points: DataFrame, segments: DataFrame, parts: int | None = None) -> DataFrame:
    """``points`` (with a column ``key``) that lie in a segment, with its rank and name.

    Sorted-range join: points and segments are range partitioned together by key,
    and a point takes the last segment that begins at or before it, if that reaches
    it.  Segments must not overlap.  A segment that begins in an earlier partition
    is carried over the border: one row a partition goes to the driver and back.
    """
    spark = points.sparkSession
    cols = points.columns
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols if c != "key"]
    s = segments.select(F.col("lo").alias("key"), *none, F.struct("hi", "rank", "name").alias("_s"), F.lit(0).alias("_point"))
    both = s.unionByName(points.select("*", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_point")))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = kept(both.repartitionByRange(n, "key").withColumn("_part", F.spark_partition_id()), "located")
    ends = {r["_part"]: r["s"] for r in both.groupBy("_part").agg(F.max_by("_s", F.when(F.col("_point") == 0, F.col("key"))).alias("s")).collect()}
    carried, last = [], None
    for p in range(n):
        carried.append((p, last))
        last = ends.get(p) or last
    carry = F.broadcast(spark.createDataFrame(carried, f"_part int, _c struct<hi:string,rank:{segments.schema['rank'].dataType.simpleString()},name:string>"))  # one row a partition
    w = Window.partitionBy("_part").orderBy("key", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_s", True).over(w)).where("_point = 1").join(carry, "_part")
    hit = F.coalesce("_last", "_c")
    return found.where(F.col("key") <= hit["hi"]).select(*cols, hit["rank"].alias("rank"), hit["name"].alias("name"))


def first_range(points: DataFrame, ranges: DataFrame, small: int = SMALL, per_slice: int = SLICE) -> DataFrame:
    """``points`` (with ``key``) that some range holds, with the rank and name of the
    first in rank.  Up to ``small`` ranges are flattened once and sent to every
    task, which finds points by bisection; more are joined by sorted ranges."""
    spark = points.sparkSession
    some = ranges.where("lo <= hi").select("lo", "hi", F.col("rank").cast("int").alias("rank"), "name").limit(small + 1).collect()
    if len(some) > small:
        return locate(points, disjoint(ranges, per_slice))
    flat = _segments(flatten([(int(r.lo, 16), int(r.hi, 16), r["rank"], r["name"]) for r in some]))
    given = spark.sparkContext.broadcast(flat.to_pydict())
    cols = points.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", rank int, name string"

    def bisected(batches: Iterator[pa.RecordBatch]):
        lo, hi = (np.array(given.value[c], f"S{DIGITS}") for c in ("lo", "hi"))
        rank, name = pa.array(given.value["rank"], pa.int32()), pa.array(given.value["name"], pa.string())
        for batch in batches:
            key = np.array(batch.column(cols.index("key")).to_pylist(), f"S{DIGITS}") if batch.num_rows else np.zeros(0, f"S{DIGITS}")
            at = np.searchsorted(lo, key, "right") - 1
            inside = np.flatnonzero((at >= 0) & (key <= hi[np.maximum(at, 0)])) if len(lo) else np.zeros(0, np.int64)
            take = pa.array(at[inside], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(inside)) for c in batch.columns), rank.take(take), name.take(take)], names=[*cols, "rank", "name"])

    return points.where("key is not null").mapInArrow(bisected, schema)


def held(points: DataFrame, intervals: DataFrame, by: str) -> DataFrame:
    """``points`` (``by``, ``key``) that lie in an interval of their own ``by``: both
    sides are made minimal and joined by the composite key."""
    glue = lambda c: F.concat(F.col(by).cast("string"), F.lit("\x01"), F.col(c))
    own = merged(intervals.where(F.col(by).isNotNull()), by).select(glue("lo").alias("lo"), glue("hi").alias("hi"), F.lit(0).alias("rank"), F.col(by).cast("string").alias("name"))
    p = points.where(F.col(by).isNotNull() & F.col("key").isNotNull()).withColumn("_key", F.col("key")).withColumn("key", glue("key"))
    return locate(p, own).withColumn("key", F.col("_key")).drop("_key", "rank", "name")
