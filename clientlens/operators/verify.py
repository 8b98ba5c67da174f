"""Whether declared agents are who they say, from tables of answers.

Lookups themselves (reverse and forward names, range feeds) are inputs: tables
keyed by address, so that a check is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_state(has_ranges: Column, inside: Column, complete: Column) -> Column:
    """pass, fail or unknown: only a whole list can say that an address is not in it."""
    return F.when(has_ranges, F.when(F.coalesce(inside, F.lit(False)), "pass").when(F.coalesce(complete, F.lit(False)), "fail").otherwise("unknown"))


def dns_state(has_domains: Column, host: Column, no_record: Column, domains: Column, forward: Column, ip: Column) -> Column:
    """pass, fail or unknown: the name must be one of the operator's and lead back
    to the address; a lookup that gave nothing either way is unknown."""
    name = F.rtrim(F.lower(host), F.lit("."))
    ours = F.exists(domains, lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))
    back = F.when(F.array_contains(forward, ip), "pass").when(F.size(forward) > 0, "fail").otherwise("unknown")
    known = F.when(ours, back).otherwise(F.lit("fail"))
    return F.when(has_domains, F.when(host.isNotNull(), known).when(F.coalesce(no_record, F.lit(False)), "fail").otherwise("unknown"))


def combined(ranges: Column, dns: Column, fallback: Column) -> Column:
    """Both channels must hold where both are declared; with ``fallback`` names
    count only where ranges cannot tell."""
    states = {"pass": "verified", "fail": "impersonator", "unknown": "unverified"}
    as_status = lambda c: F.when(c.isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), c))
    both = (
        F.when((ranges == "fail") | (dns == "fail"), "impersonator").when((ranges == "pass") & (dns == "pass"), "verified").otherwise("unverified")
    )
    lead = F.when(ranges == "unknown", as_status(dns)).otherwise(as_status(ranges))
    two = F.when(F.coalesce(fallback, F.lit(False)), lead).otherwise(both)
    return F.when(ranges.isNotNull() & dns.isNotNull(), two).otherwise(F.coalesce(as_status(ranges), as_status(dns), F.lit("unverified")))


def asn_tier(status: Column, asn: Column, asns: Column) -> Column:
    """A verified client stays so; else an AS of the agent's list associates it, and
    a known AS outside a list makes an impersonator."""
    asked = (F.coalesce(F.size(asns), F.lit(0)) > 0) & asn.isNotNull()
    return F.when(status == "verified", status).when(asked & F.array_contains(asns, asn), "asn-associated").when(asked, "impersonator").otherwise(status)


def matched_domain(host: Column, domains: Column) -> Column:
    """The first expected domain that ends the host's name, else the first one,
    else the host."""
    name = F.rtrim(F.lower(host), F.lit("."))
    hit = F.get(F.filter(domains, lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d))), F.lit(0))
    return F.coalesce(hit, F.get(domains, F.lit(0)), host, F.lit("verified"))


def verify(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """``claims`` (client_ip, agent_token, as_number, domains, asns, has_ranges,
    inside, complete, fallback) with range_state, dns_state, status and domain.

    ``answers``: (ip, host, no_record, forward), one row an address."""
    a = answers.withColumnRenamed("ip", "_ip")
    d = claims.join(a, F.col("client_ip") == F.col("_ip"), "left").drop("_ip")
    d = d.withColumns({
        "range_state": range_state(F.col("has_ranges"), F.col("inside"), F.col("complete")),
        "dns_state": dns_state(F.size("domains") > 0, F.col("host"), F.col("no_record"), F.col("domains"), F.col("forward"), F.col("client_ip")),
    })
    status = combined(F.col("range_state"), F.col("dns_state"), F.col("fallback"))
    d = d.withColumn("status", asn_tier(status, F.col("as_number"), F.col("asns")))
    return d.withColumn("domain", F.when(F.col("status") == "verified", matched_domain(F.col("host"), F.col("domains"))))


def merge_verified(clients: DataFrame) -> DataFrame:
    """One row per operator domain and agent of verified clients (status, domain,
    agent_token): their addresses, requests and bytes, first and last request."""
    return clients.where("status = 'verified'").groupBy("domain", "agent_token").agg(
        F.array_sort(F.collect_set("client_ip")).alias("member_ips"), F.sum("requests").alias("requests"), F.sum("total_bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
