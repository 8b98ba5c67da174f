"""Where clients come from: ranges, AS numbers, folds and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.hosts import range_key, subnet
from clientlens.operators import intervals
from clientlens.sources.shared import kept


def in_ranges(ips: DataFrame, ranges: DataFrame, column: str = "remote_host") -> DataFrame:
    """(ip, rank, name): the first range list in order that holds an address.  Each
    distinct address is looked up once, by a sorted-range join."""
    d = ips.select(F.col(column).alias("ip")).distinct().withColumn("key", range_key(F.col("ip"))).where("key is not null")
    return intervals.first_range(d, ranges).select("ip", "rank", "name")


def in_own_ranges(claims: DataFrame, ranges: DataFrame, by: str = "agent_token") -> DataFrame:
    """(by, ip) of ``claims`` whose address lies in a range published for the same
    ``by``; an agent's list counts whole, in whatever order it is."""
    d = claims.select(by, F.col("client_ip").alias("ip")).distinct().withColumn("key", range_key(F.col("ip"))).where("key is not null")
    return intervals.held(d, ranges, by).select(by, "ip")


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last key of an IPv4 or IPv6 prefix."""
    ip, bits = F.split(cidr, "/")[0], F.coalesce(F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int"), F.lit(128))
    key = range_key(ip)
    fixed = F.when(ip.contains(":"), bits).otherwise(F.lit(96) + F.least(bits, F.lit(32)))
    whole, part = F.floor(fixed / 4).cast("int"), (fixed % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.pow(F.lit(2), 4 - part).cast("int")
    first = (F.floor(digit / size) * size).cast("int")
    rest = F.lit(31) - whole
    lo = F.concat(F.substring(key, F.lit(1), whole), F.lower(F.hex(first)), F.repeat(F.lit("0"), rest))
    hi = F.concat(F.substring(key, F.lit(1), whole), F.lower(F.hex(first + size - 1)), F.repeat(F.lit("f"), rest))
    return F.when(fixed == 128, key).otherwise(lo), F.when(fixed == 128, key).otherwise(hi)


def route(entries: DataFrame, identity: tuple[Column, Column] | None = None) -> DataFrame:
    """Route and group key of each entry: proxies fold by network and UA, agents
    that own their AS by name, declared crawlers and hosting by subnet, the rest
    by client, which ``identity`` names.  Needs egress, as_agent, agent_token,
    ua_crawler and hosting; crawlers marked ``resident`` stay single clients."""
    ip, said = identity or (F.col("remote_host"), F.col("user_agent"))
    net = F.coalesce(subnet(F.col("remote_host")), F.col("remote_host"))
    stays = F.coalesce("resident", F.lit(False)) if "resident" in entries.columns else F.lit(False)
    kind = (
        F.when(F.col("egress").isNotNull(), "egress").when(F.col("as_agent").isNotNull(), "as_agent")
        .when(F.col("ua_crawler") & ~stays, "declared").when(~F.col("ua_crawler") & F.col("hosting").isNotNull(), "hosting").otherwise("regular")
    )
    none = F.lit(None).cast("string")
    key = F.when(kind == "egress", F.col("egress")).when(kind == "as_agent", F.col("as_agent")).when(kind == "regular", ip).otherwise(net)
    ua = F.when(kind == "as_agent", none).when(kind == "declared", F.col("agent_token")).when(kind == "regular", said).otherwise(F.col("user_agent"))
    return entries.withColumns({"route": kind, "client_ip": key, "client_ua": ua})


def residents(entries: DataFrame, keys: list[str], most: int = C.RESIDENT_CAP) -> DataFrame:
    """The first ``most`` distinct ``keys`` in the order of ``entries`` (seq).

    First places are range partitioned; counts of the partitions, one row each, say
    in which of them the limit falls, and only there rows are numbered.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = entries.groupBy(*keys).agg(F.min("seq").alias("seq"))
    first = kept(first.repartitionByRange(n, "seq").withColumn("_part", F.spark_partition_id()), "first-places")
    before, at, rest = 0, -1, 0
    for r in sorted(first.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + r["n"] > most:
            at, rest = r["_part"], most - before
            break
        before += r["n"]
    else:
        return first.select(*keys)
    border = first.where(F.col("_part") == at).orderBy("seq").limit(rest)
    return first.where(F.col("_part") < at).select(*keys).unionByName(border.select(*keys))


def redirect_sides(flagged: DataFrame) -> DataFrame:
    """Per site: requests and redirects of its www. and its bare host."""
    www = F.col("host").startswith("www.")
    red = F.coalesce(F.col("status").between(300, 399), F.lit(False))
    return flagged.where("host is not null").groupBy("site").agg(
        F.count(F.lit(1)).alias("requests"), F.min("seq").alias("first"), F.count_if(www).alias("www"), F.count_if(www & red).alias("www_3xx"),
        F.count_if(~www).alias("bare"), F.count_if(~www & red).alias("bare_3xx"),
    )


def redirect_shadow(sides: DataFrame, least: int = 50, ratio: float = 0.9) -> DataFrame:
    """One row: the side (www or apex) of the busiest site that only redirects, if
    one side alone does."""
    www = (F.col("www") >= least) & (F.col("www_3xx") >= F.col("www") * ratio)
    bare = (F.col("bare") >= least) & (F.col("bare_3xx") >= F.col("bare") * ratio)
    return sides.orderBy(F.desc("requests"), "first").limit(1).select("site", F.when(www & ~bare, "www").when(bare & ~www, "apex").alias("shadow"))


def resolve_as(forced: Column, db: Column, logged: Column, feed: Column) -> Column:
    """AS number of a client: a forced one, else the database's, else the log's,
    else that of a published prefix."""
    return F.coalesce(forced, db, logged, feed).cast("bigint")


def provider(clients: DataFrame, by_asn: DataFrame) -> DataFrame:
    """``clients`` (hosting, as_number and, if known, verified_domain) with network
    and category: the hosting range's name, else that of the AS (the first of the
    list), an agent's own network, a verified operator's domain, else residential.

    ``by_asn``: (rank, asn, name, role) with role "provider" or "agent"."""
    first = by_asn.groupBy("asn", "role").agg(F.min_by("name", "rank").alias("name"))
    named = lambda role: first.where(F.col("role") == role).select(F.col("asn").alias("as_number"), F.col("name").alias(f"_{role}"))
    d = clients if "verified_domain" in clients.columns else clients.withColumn("verified_domain", F.lit(None).cast("string"))
    d = d.join(named("provider"), "as_number", "left").join(named("agent"), "as_number", "left")
    found = F.coalesce("hosting", "_provider", "_agent", "verified_domain")
    return d.withColumns({
        "network": F.coalesce(found, F.lit(C.RESIDENTIAL)), "category": F.when(found.isNotNull(), "datacenter").otherwise("residential"),
    }).drop("_provider", "_agent")


def nonce_use(claims: DataFrame) -> DataFrame:
    """(nonce, uses, replayed, reused): a nonce seen from another address than
    its first is replayed, again from the same one reused."""
    first = F.min_by("remote_host", "seq")
    return claims.where("nonce is not null").groupBy("nonce").agg(
        F.count(F.lit(1)).alias("uses"), first.alias("first_ip"), (F.count_distinct("remote_host") > 1).alias("replayed"),
    ).withColumn("reused", (F.col("uses") > 1) & ~F.col("replayed"))
