"""What a run did not recognise: clusters by volume, and majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
# Tags that confirm a declared crawler, and those that assert forgery or hostility.
CONFIRMED = ["dns-verified", "ip-verified", "wba-verified", "asn-associated"]
SUSPECT = ["forged-referer", "impossible-referer", "impossible-browser-ua", "wba-violation", "wba-replay", "ua-rotating", "probe-paths", "traversal", "encoding-evasion"]


def _most(counts: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values of each key as texts "value xN"; ties by value."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    text = F.concat(F.coalesce(F.col(value), F.lit("-")), F.lit(" x"), F.col("n").cast("string"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"]), ", ").alias(name))


def clusters(clients: DataFrame, section: Column, key: Column, top: int = TOP, values: int = 3) -> DataFrame:
    """(section, place, key, requests, clients, kinds, agents, more) of the ``top`` keys
    by volume in each section; ``more`` keys of the section are not shown.

    Volumes, kinds and agents are counted by key with partial sums first; a section
    that holds all clients is no group of its own until only keys are left.
    """
    c = clients.select(section.alias("section"), key.alias("key"), "requests", "kind", "user_agent").where("section is not null and key is not null")
    own = ["section", "key"]
    sums = c.groupBy(*own).agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("clients"))
    w = Window.partitionBy("section").orderBy(F.desc("requests"), "key")
    shown = sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    more = sums.groupBy("section").agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("more"))
    few = c.join(F.broadcast(shown.select(*own)) if top <= 1000 else shown.select(*own), own, "left_semi")
    kinds = _most(few.groupBy(*own, "kind").agg(F.count(F.lit(1)).alias("n")), own, "kind", values, "kinds")
    agents = _most(few.groupBy(*own, "user_agent").agg(F.count(F.lit(1)).alias("n")), own, "user_agent", values, "agents")
    return shown.join(kinds, own).join(agents, own).join(more, "section").select("section", "place", "key", "requests", "clients", "kinds", "agents", "more")


def sections() -> Column:
    """Where a client's User-Agent or AS belongs in the digest, if anywhere."""
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    return F.when(has("declares-known-bot") & ~has(*CONFIRMED), "recognised, unverified").when(~has("declares-known-bot") & has("bot-ua"), "unrecognised bots")


def digest(clients: DataFrame, top: int = TOP) -> DataFrame:
    """Clusters of declared but unverified crawlers by User-Agent, of ASes that no
    list knows, and of suspect tags."""
    agents = clusters(clients, sections(), F.coalesce("user_agent", F.lit("-")), top)
    out = agents
    if "as_number" in clients.columns:
        home = F.when(~F.col("datacenter") & F.col("as_number").isNotNull(), "unrecognised ASes")
        out = out.unionByName(clusters(clients, home, F.col("as_number").cast("string"), top))
    flags = clients.withColumn("_flag", F.explode(F.array_union(F.array_intersect("tags", F.array(*map(F.lit, SUSPECT))), F.when(F.col("kind") == "impersonator", F.array(F.lit("impersonator"))).otherwise(F.array().cast("array<string>")))))
    return out.unionByName(clusters(flags, F.lit("suspect"), F.col("_flag"), top))


def majority(votes: DataFrame, keys: list[str], value: str, weight: Column, share: float = 0.5) -> DataFrame:
    """(keys, value): the value with more than ``share`` of a key's weight, if any;
    votes without a value do not count.  Weights are summed by value first."""
    per = votes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    own = per.groupBy(*keys).agg(F.max_by(value, "_w").alias(value), F.max("_w").alias("_top"), F.sum("_w").alias("_all"))
    return own.where(F.col("_top") > F.col("_all") * share).select(*keys, value)


def member_countries(members: DataFrame, countries: DataFrame) -> DataFrame:
    """(client, country) of clients from their addresses (client_ip, client_ua, ip): that
    of more than half of those with a country.  ``countries``: (ip, country,
    suppressed); an address that is no one place does not count."""
    c = countries.where("not coalesce(suppressed, false) and country is not null").select("ip", "country")
    return majority(members.join(c, "ip"), ["client_ip", "client_ua"], "country", F.lit(1))


def site_host(entries: DataFrame) -> DataFrame:
    """One row at most: the host that more than half of the referers name."""
    return majority(entries.where("ref_host is not null").withColumn("_one", F.lit(0)), ["_one"], "ref_host", F.lit(1)).select(F.col("ref_host").alias("site"))
