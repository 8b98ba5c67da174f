"""Rollups, top lists, outlier thresholds and display groups of classified clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens import config as C


def verified() -> Column:
    """Clients that a check confirmed, unless it showed an impersonator."""
    return F.arrays_overlap("tags", F.array(*map(F.lit, C.VERIFIED_TAGS))) & (F.col("kind") != "impersonator")


def kind_rollup(clients: DataFrame, *keys: str) -> DataFrame:
    """Exact totals by kind, or by further keys too; with a column ``verdict``, how
    many keep to robots.txt, and of verified clients their part of the totals."""
    sure = F.coalesce(verified(), F.lit(False))
    robots = [F.count_if(F.col("verdict") == v).alias(f"{v}_robots") for v in ("respects", "ignores", "unknown")] if "verdict" in clients.columns else []
    return clients.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("clients"), F.sum("requests").alias("requests"), F.sum("total_bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *robots,
        F.count_if(sure).alias("verified_clients"), F.coalesce(F.sum(F.when(sure, F.col("requests"))), F.lit(0)).alias("verified_requests"),
        F.coalesce(F.sum(F.when(sure, F.col("total_bytes"))), F.lit(0)).alias("verified_bytes"),
    )


def identity_stats(clients: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: clients, those with one request, addresses with several User-Agents."""
    uas = entries.groupBy("remote_host").agg((F.count_distinct("user_agent") + F.max(F.col("user_agent").isNull().cast("int"))).alias("n"))
    own = clients.agg(F.count(F.lit(1)).alias("client_count"), F.count_if(F.col("requests") == 1).alias("singletons"))
    return own.crossJoin(uas.agg(F.count_if(F.col("n") > 1).alias("ips_with_multiple_uas")))  # one row each


def network_rollup(clients: DataFrame) -> DataFrame:
    """By kind, and by network and kind: two grouping sets, one pass."""
    return clients.groupingSets([["kind"], ["network", "kind"]], "network", "kind").agg(
        F.grouping("network").alias("all_networks"), F.count(F.lit(1)).alias("clients"), F.sum("requests").alias("requests")
    )


def top_clients(clients: DataFrame, k: int = C.MAX_PER_KIND) -> DataFrame:
    """The ``k`` busiest clients of each kind (0: all); ties by client key."""
    if not k:
        return clients
    w = Window.partitionBy("kind").orderBy(F.desc("requests"), "client_ip", F.asc_nulls_first("client_ua"))
    return clients.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def cadence(entries: DataFrame) -> DataFrame:
    """Requests on a grid of five minutes, by kind."""
    slot = F.floor(F.unix_seconds("ts") / C.GRID_SECONDS) * C.GRID_SECONDS
    return entries.where("ts is not null").groupBy("kind", slot.alias("slot")).agg(F.count(F.lit(1)).alias("requests"))


def kind_cadence(clients: DataFrame, buckets: DataFrame) -> DataFrame:
    """Requests on the grid, by kind, from clients' own forty slots: each slot at
    its midpoint, and a client that stayed within a minute at its first request.
    ``buckets`` is that of :func:`clientlens.operators.clients.request_buckets`."""
    b = buckets.withColumnsRenamed({"client_ip": "_i", "client_ua": "_u", "requests": "hits"})
    j = clients.where("first_seen is not null").join(b, F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_u")), "left")
    begin, span = F.unix_micros("first_seen") / 1e6, F.col("duration")
    at = F.when(F.col("bucket").isNotNull(), begin + (F.col("bucket") + 0.5) / C.BUCKETS * span).otherwise(begin)
    slot = (F.floor(at / C.GRID_SECONDS) * C.GRID_SECONDS).alias("slot")
    return j.groupBy("kind", slot).agg(F.sum(F.coalesce("hits", "requests")).alias("requests"))


def metrics() -> dict:
    return {"rate": F.col("peak_rpm").cast("double"), "bytes": F.col("mean_bytes"), "breadth": F.col("breadth"), "session": F.col("duration")}


def thresholds(clients: DataFrame) -> DataFrame:
    """One row: what is out of the ordinary, from clients that act as browsers do:
    they say so, load the assets of pages, and keep a cache or follow links.

    The 95th percentile of each metric's positive values times a margin, of the
    breadth, a share, that of all values alone; never under its floor, and with
    fewer than thirty reference clients the floor alone.
    """
    acts = (F.col("n304") > 0) | ((F.col("referers") > 0) & (F.col("follow_ratio") > 0.3))
    ref = F.col("ua_browser") & (F.col("requests") >= C.LEAST_REQUESTS) & (F.col("page_count") > 0) & (F.col("coload_ratio") > 0.4) & acts
    out, pool = [], clients.where(ref)
    for name, c in metrics().items():
        part = "" if name == "breadth" else f" filter (where m_{name} > 0)"
        p = F.expr(f"percentile_disc(0.95) within group (order by m_{name}){part}") * F.lit(1.0 if name == "breadth" else C.MARGIN)
        floor = F.lit(C.FLOORS[name])
        out.append(F.when(F.count(F.lit(1)) < C.LEAST_POOL, floor).otherwise(F.greatest(floor, F.coalesce(p, floor))).alias(f"t_{name}"))
    return pool.withColumns({f"m_{k}": c for k, c in metrics().items()}).agg(F.count(F.lit(1)).alias("pool"), *out)


def outlier_tags(clients: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds high-rate, high-bytes, wide-breadth and long-session tags.  ``limits``
    is one row, so Spark broadcasts it."""
    names = {"rate": "high-rate", "bytes": "high-bytes", "breadth": "wide-breadth", "session": "long-session"}
    quiet = F.col("kind").isin("unknown", "automation")
    j = clients.crossJoin(F.broadcast(limits))
    on = [
        F.when((F.col("requests") >= C.LEAST_REQUESTS) & (m > F.col(f"t_{k}")) & (F.lit(k in ("rate", "bytes")) | ~quiet), F.lit(names[k]))
        for k, m in metrics().items()
    ]
    return j.withColumn("tags", F.array_sort(F.array_union("tags", F.array_compact(F.array(*on))))).drop("pool", *[f"t_{k}" for k in names])


def actors(clients: DataFrame) -> DataFrame:
    """Clients with one User-Agent and the same telling tags, as one actor."""
    telling = F.array_except("tags", F.array(*map(F.lit, C.OBSERVATIONAL)))
    g = clients.groupBy("user_agent", F.array_join(telling, ",").alias("actor_tags")).agg(
        F.count(F.lit(1)).alias("members"), F.sum("requests").alias("requests"), F.max(F.struct("requests", "client_ip")).alias("lead"))
    slug = F.substring(F.sha1(F.concat_ws("|", F.col("lead.client_ip"), F.coalesce("user_agent", F.lit("")), F.lit("")).cast("binary")), 1, 16)
    return g.select("user_agent", "actor_tags", "members", "requests", F.col("lead.client_ip").alias("lead_ip"), slug.alias("slug"))


def matrix(rollup: DataFrame, top: int = 6) -> DataFrame:
    """Kind by network, with every request of ``rollup`` (kind, network, requests
    and, if there are any, egress) in one column.

    The ``top`` largest hosting networks have columns, and so has each other one
    that holds BREAKOUT_SHARE of a single kind and is not negligible overall; the
    rest is OTHER_HOSTING.  Egress networks are columns of their own, and clients
    outside all networks are RESIDENTIAL.  No rows if there are only those.
    """
    egress = F.col("egress") if "egress" in rollup.columns else F.lit(None).cast("string")
    category = F.when(egress.isNotNull(), "egress").when(F.col("network").isNotNull(), "datacenter").otherwise("residential")
    r = rollup.select("kind", category.alias("category"), F.coalesce(egress, "network", F.lit(C.RESIDENTIAL)).alias("network"), "requests")
    r = r.groupBy("kind", "category", "network").agg(F.sum("requests").alias("requests"))
    # a row per kind and network is left, so windows over all of it are small
    everything, net = Window.partitionBy(F.lit(1)), Window.partitionBy("category", "network")
    r = r.withColumns({
        "row_total": F.sum("requests").over(Window.partitionBy("kind")), "n": F.sum("requests").over(net),
        "total": F.sum("requests").over(everything), "mixed": F.max(F.col("category") != "residential").over(everything),
    })
    large = F.max(F.col("requests") >= F.col("row_total") * C.BREAKOUT_SHARE).over(net)
    order = Window.partitionBy("category").orderBy(F.desc("n"), "network")
    guard = F.greatest(F.col("total") * C.GUARD_SHARE, F.lit(float(C.GUARD_REQUESTS)))
    r = r.where("mixed").withColumns({"large": large, "i": F.dense_rank().over(order)})
    shown = (F.col("category") != "datacenter") | (F.col("i") <= top) | (F.col("large") & (F.col("n") >= guard))
    return r.groupBy("kind", F.when(shown, F.col("network")).otherwise(C.OTHER_HOSTING).alias("column")).agg(F.sum("requests").alias("requests"))


def select_clients(clients: DataFrame, kind=None, tag=None, client=None, network=None) -> DataFrame:
    """Clients that meet all conditions given; tag, client and network match parts."""
    out = clients
    if kind:
        out = out.where(F.col("kind") == kind.replace(" ", "_").replace("-", "_"))
    if tag:
        out = out.where(F.exists("tags", lambda t: t.contains(tag)))
    if client:
        out = out.where((F.col("client_ip") == client) | F.col("client_ip").contains(client))
    if network:
        out = out.where(F.lower("network").contains(network.lower()))
    return out


def conflicts(scored: DataFrame, least: float = 0.4) -> DataFrame:
    """Clients that at least two kinds claim with a score of ``least``."""
    kinds = [c for c in scored.columns if c.startswith("s_")]
    n = sum((F.when(F.col(c) >= least, 1).otherwise(0) for c in kinds), F.lit(0))
    return scored.withColumn("claims", n).where("claims >= 2")
