"""Hosts, sites and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_host(host: Column) -> Column:
    """Lower-cased host without port or IPv6 brackets."""
    return F.lower(F.regexp_replace(F.regexp_replace(host, r"^\[([^\]]*)\](?::\d+)?$", "$1"), r"^([^:]*):\d+$", "$1"))


def referer_host(referer: Column) -> Column:
    """Host of an http(s) referer, null if there is none."""
    h = F.regexp_extract(referer, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\](?::\d+)?|[^/?#]*)", 1)
    return F.when(h != "", bare_host(h))


def site_key(host: Column) -> Column:
    """A host with one leading ``www.`` dropped."""
    return F.regexp_replace(bare_host(host), r"^www\.", "")


def referer_path(referer: Column) -> Column:
    """Path of a referer: scheme, host and query dropped; no slash gives "/"."""
    rest = F.regexp_replace(F.split(referer, r"\?", 2)[0], r"^[^/]*://[^/]*", "")
    return F.when(referer.isNotNull(), F.when(rest == "", F.lit("/")).otherwise(rest))


def normal_ip(ip: Column) -> Column:
    """IPv4-mapped IPv6 written as IPv4."""
    return F.regexp_replace(F.trim(ip), r"(?i)^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = F.split(normal_ip(ip), r"\.")
    n = sum((F.get(p, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(p, F.lit(0)).try_cast("bigint") * F.lit(256**3))
    return F.when(normal_ip(ip).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), n)


def ipv6_groups(ip: Column) -> Column:
    """Eight 4-digit groups of an IPv6 address; null for anything else."""
    halves = F.split(F.lower(F.trim(ip)), "::")
    side = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    head, tail = side(halves[0]), F.when(F.size(halves) > 1, side(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(head) - F.size(tail)
    full = F.concat(head, F.when(gap > 0, F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>")), tail)
    ok = ip.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":") & (F.size(halves) <= 2) & (F.size(full) == 8)
    return F.when(ok, F.transform(full, lambda g: F.lpad(g, 4, "0")))


def subnet(ip: Column, v6_groups: int = 3) -> Column:
    """/24 of an IPv4 address, /48 (three groups) or /64 (four) of an IPv6 one."""
    v4 = F.concat(F.substring_index(normal_ip(ip), ".", 3), F.lit(".0/24"))
    g = ipv6_groups(ip)
    short = F.array_join(F.transform(F.slice(g, 1, v6_groups), lambda x: F.regexp_replace(x, "^0{1,3}", "")), ":")
    return F.when(ipv4_number(ip).isNotNull(), v4).when(g.isNotNull(), F.concat(short, F.lit(f"::/{16 * v6_groups}")))


def range_key(ip: Column) -> Column:
    """32 hexadecimal digits that compare as addresses do, for both versions."""
    v4 = F.lpad(F.concat(F.lit("ffff"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")), 32, "0")
    return F.coalesce(F.when(ipv4_number(ip).isNotNull(), v4), F.array_join(ipv6_groups(ip), ""))


def as_number(value: Column) -> Column:
    """``AS123`` or ``123`` as a number."""
    return F.regexp_replace(F.trim(value), "(?i)^as", "").try_cast("bigint")
