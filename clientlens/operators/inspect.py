"""Looking at single clients: traces as a forest of pages and assets, and request
patterns on one shared axis of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.operators.clients import KEY, by_client


def trace_order() -> list[Column]:
    """By time, those without one last, ties in the order of the log."""
    return [F.col("ts").isNull(), F.col("ts"), F.col("seq")]


def cascade(traces: DataFrame) -> DataFrame:
    """Rows of ``traces`` (the first entries of each client, so few a client) with
    ``place``, ``page`` (0 before the first one), ``depth`` and ``offset``.

    Every entry that is no asset opens a page.  An asset nests where its referer
    names the page or what nested under it before: depth 1 under the page, one more
    under an asset.  A nested asset's offset is that from its page, any other
    entry's that from the last entry that was not nested, in seconds.
    """
    w = by_client().orderBy(*trace_order())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = traces.withColumns({"place": F.row_number().over(w), "page": F.sum((~F.col("static")).cast("int")).over(upto)})
    row = F.struct("place", "path", F.when(F.col("has_referer"), F.col("ref_path")).alias("ref"), "static")
    groups = d.groupBy(*KEY, "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(acc, x):
        at = F.when(x["static"], F.array_position(acc["paths"], x["ref"]))
        depth = F.when(at > 0, F.get(acc["depths"], (at - 1).cast("int")) + 1).otherwise(0)
        joins = (~x["static"] | (depth > 0)) & (x["path"] != "") & ~F.array_contains(acc["paths"], x["path"])
        # an entry that opens the page begins with an empty list
        return F.struct(
            F.when(joins, F.array_append(acc["paths"], x["path"])).otherwise(acc["paths"]).alias("paths"), F.when(joins, F.array_append(acc["depths"], depth)).otherwise(acc["depths"]).alias("depths"),
            F.array_append(acc["out"], F.struct(x["place"].alias("place"), depth.alias("depth"))).alias("out"),
        )

    start = F.struct(F.array().cast("array<string>").alias("paths"), F.array().cast("array<int>").alias("depths"), F.array().cast("array<struct<place:int,depth:int>>").alias("out"))
    found = groups.select(*KEY, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select(F.col(KEY[0]).alias("_i"), F.col(KEY[1]).alias("_u"), F.col("x.place").alias("_p"), "x.depth")
    same = (F.col("place") == F.col("_p")) & F.col(KEY[0]).eqNullSafe(F.col("_i")) & F.col(KEY[1]).eqNullSafe(F.col("_u"))
    d = d.join(found, same).drop("_i", "_u", "_p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    top = F.last(F.when(F.col("depth") == 0, F.col("ts")), True).over(before)
    opened = F.last(F.when(~F.col("static"), F.col("ts")), True).over(upto)
    origin = F.when(F.col("depth") > 0, opened).otherwise(F.coalesce(top, F.first("ts", True).over(upto)))
    return d.withColumn("offset", (F.unix_micros("ts") - F.unix_micros(origin)) / 1e6)


def axis(clients: DataFrame) -> DataFrame:
    """One row: the first and the last time of all clients, in seconds."""
    return clients.agg(F.min(F.unix_micros("first_seen")).alias("_w0"), F.max(F.unix_micros("last_seen")).alias("_w1")).select((F.col("_w0") / 1e6).alias("_w0"), ((F.col("_w1") - F.col("_w0")) / 1e6).alias("_full"))


def _slot(at: Column) -> Column:
    return F.least(F.greatest(F.floor((at - F.col("_w0")) / F.col("_full") * C.BUCKETS), F.lit(0)), F.lit(C.BUCKETS - 1)).cast("int")


def on_axis(clients: DataFrame, buckets: DataFrame) -> DataFrame:
    """(client, slot, requests): a client's own forty slots placed, each by its
    midpoint, on the forty slots that all clients share; one that stayed within a
    minute is a single spike.  No request is lost.  The axis is one row."""
    b = buckets.withColumnsRenamed({"client_ip": "_i", "client_ua": "_u", "requests": "hits"})
    c = clients.where("first_seen is not null").crossJoin(F.broadcast(axis(clients))).where("_full > 0")
    j = c.join(b, F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_u")), "left")
    begin = F.unix_micros("first_seen") / 1e6
    at = F.when(F.col("bucket").isNotNull(), begin + (F.col("bucket") + 0.5) / C.BUCKETS * F.col("duration")).otherwise(begin)
    return j.groupBy(*KEY, _slot(at).alias("slot")).agg(F.sum(F.coalesce("hits", "requests")).alias("requests"))


def kinds_on_axis(cadence: DataFrame, clients: DataFrame) -> DataFrame:
    """(kind, slot, requests) of a cadence grid on the shared axis, by the midpoint of
    each grid cell."""
    c = cadence.crossJoin(F.broadcast(axis(clients))).where("_full > 0")
    return c.groupBy("kind", _slot(F.col("slot") + C.GRID_SECONDS / 2).alias("bin")).agg(F.sum("requests").alias("requests")).withColumnRenamed("bin", "slot")


def patterns(placed: DataFrame, members: DataFrame, actor: str = "actor") -> DataFrame:
    """(actor, slot, requests, peak): members' slots summed, and the busiest slot of
    all actors, one scale for all.  ``members``: (client, actor)."""
    m = members.select(F.col(KEY[0]).alias("_i"), F.col(KEY[1]).alias("_u"), actor)
    j = placed.join(m, F.col(KEY[0]).eqNullSafe(F.col("_i")) & F.col(KEY[1]).eqNullSafe(F.col("_u")))
    sums = j.groupBy(actor, "slot").agg(F.sum("requests").alias("requests"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("requests").alias("peak"))))  # one row
