"""Published range lists, nine formats, to minimal sets of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions.hosts import ipv4_number, normal_ip, range_key
from clientlens.operators.intervals import merged
from clientlens.operators.network import cidr_bounds

#: Share of all IPv4 addresses, and of the IPv6 ones, beyond which a list is refused.
MOST_COVERED = 0.25
# Keys of a prefix object, in the order in which they are read.
PREFIX_KEYS = ("ipv4Prefix", "ipv6Prefix", "ip_prefix", "ipv6_prefix")
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#47;", "/"), ("&#x2F;", "/"), ("&amp;", "&"))

def _none() -> Column:
    return F.array().cast("array<string>")


def _present(items: Column) -> Column:
    return F.filter(F.coalesce(items, _none()), lambda x: x.isNotNull() & (x != ""))


def _fields(objects: Column, *names: str) -> Column:
    """Values of some fields of JSON objects (as texts), object by object."""
    schema = ", ".join(f"{n} string" for n in names)

    def of(x):
        j = F.from_json(x, schema)
        return F.array(*[j[n] for n in names])

    return _present(F.flatten(F.transform(F.filter(F.coalesce(objects, _none()), lambda x: x.startswith("{")), of)))


def prefixes(text: Column) -> Column:
    """``{"prefixes": [...]}`` of strings or of objects with any of four keys."""
    items = F.coalesce(F.from_json(text, "prefixes array<string>")["prefixes"], _none())
    one = lambda x: F.when(x.startswith("{"), _fields(F.array(x), *PREFIX_KEYS)).otherwise(F.array(x))
    return _present(F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), one)))


def code_blocks(text: Column) -> Column:
    """Prefix lists in the <code> blocks of a page, else the text itself."""
    plain = lambda x: reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<code[^>]*>(.*?)</code>"), F.lit(1))
    found = F.flatten(F.transform(blocks, lambda b: prefixes(plain(b))))
    return F.when(F.size(found) > 0, found).otherwise(prefixes(text))


def two_lists(text: Column) -> Column:
    j = F.from_json(text, "prefixes array<string>, ipv6_prefixes array<string>")
    return F.concat(_fields(j["prefixes"], "ip_prefix"), _fields(j["ipv6_prefixes"], "ipv6_prefix"))


def service_tags(text: Column) -> Column:
    values = F.from_json(text, "values array<struct<properties:struct<addressPrefixes:array<string>>>>")["values"]
    return _present(F.flatten(F.filter(F.transform(values, lambda v: v["properties"]["addressPrefixes"]), lambda x: x.isNotNull())))


def lines(text: Column) -> Column:
    return _present(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.split(x, "#")[0])))


def first_cells(text: Column) -> Column:
    cells = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.split(x, ",")[0]))
    return F.filter(_present(cells), lambda x: x.contains("/"))


def geofeed(text: Column) -> Column:
    return _fields(F.from_json(text, "subnets array<string>")["subnets"], "ip_prefix")


def announced(text: Column) -> Column:
    return _fields(F.from_json(text, "data struct<prefixes:array<string>>")["data"]["prefixes"], "prefix")


def regions(text: Column) -> Column:
    r = F.from_json(text, "regions array<struct<cidrs:array<string>>>")["regions"]
    return _fields(F.flatten(F.filter(F.transform(r, lambda x: x["cidrs"]), lambda x: x.isNotNull())), "cidr")


#: Readers by format name; an unknown name reads as "prefixes".
FORMATS = {
    "prefixes": prefixes, "amazon": code_blocks, "aws": two_lists, "azure": service_tags, "text": lines, "csv": first_cells,
    "subnets": geofeed, "oracle": regions, "ripestat": announced,
}


def cidrs(text: Column, kind: Column) -> Column:
    """Prefixes in a list's text, as they are written; a broken text gives none."""
    out = prefixes(text)
    for name, read in FORMATS.items():
        out = F.when(kind == name, read(text)).otherwise(out)
    return F.coalesce(out, _none())


def well_formed(cidr: Column) -> Column:
    """An address of either version, alone or with a length that fits it."""
    ip, size = F.split(cidr, "/")[0], F.get(F.split(cidr, "/"), F.lit(1))
    most = F.when(ipv4_number(ip).isNotNull() & ~ip.contains(":"), 32).otherwise(128)
    length = F.when(F.size(F.split(cidr, "/")) == 1, most).when(size.rlike(r"^\d{1,3}$"), size.cast("int"))
    return range_key(ip).isNotNull() & F.coalesce(length.between(0, most), F.lit(False)) & (normal_ip(ip) == ip)


def _number(key: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(key, first, digits), 16, 10).cast("double")


def coverage(intervals: DataFrame) -> DataFrame:
    """(feed, v4_share, v6_share) of minimal intervals."""
    v4 = F.col("lo") < "0" * 19 + "1"
    size4 = _number(F.col("hi"), 25, 8) - _number(F.col("lo"), 25, 8) + 1
    size6 = (_number(F.col("hi"), 1, 12) - _number(F.col("lo"), 1, 12)) / 2.0**48 + (_number(F.col("hi"), 13, 12) - _number(F.col("lo"), 13, 12)) / 2.0**96
    return intervals.groupBy("feed").agg(
        F.coalesce(F.sum(F.when(v4, size4)), F.lit(0.0)).alias("v4"), F.coalesce(F.sum(F.when(~v4, size6)), F.lit(0.0)).alias("v6_share"), F.count(F.lit(1)).alias("intervals")
    ).select("feed", (F.col("v4") / 2.0**32).alias("v4_share"), "v6_share", "intervals")


def feed_intervals(feeds: DataFrame, most: float = MOST_COVERED) -> tuple[DataFrame, DataFrame]:
    """((feed, lo, hi), report) of lists (feed, kind, text).

    Prefixes are merged to the fewest intervals of each feed.  The report has a
    row a feed: prefixes read, malformed ones, intervals, shares of the address
    spaces, and a problem: "empty" where nothing could be read, "covers too much"
    beyond ``most`` of a space.  A feed with a problem gives no interval.
    """
    c = feeds.select("feed", F.explode_outer(cidrs(F.col("text"), F.col("kind"))).alias("cidr")).withColumn("good", F.coalesce(well_formed(F.col("cidr")), F.lit(False)))
    lo, hi = cidr_bounds(F.col("cidr"))
    whole = merged(c.where("good").select("feed", lo.alias("lo"), hi.alias("hi")), "feed")
    counts = c.groupBy("feed").agg(F.count_if("good").alias("prefixes"), F.count_if(F.col("cidr").isNotNull() & ~F.col("good")).alias("malformed"))
    report = counts.join(coverage(whole), "feed", "left").fillna(0, ["intervals"]).fillna(0.0, ["v4_share", "v6_share"])
    report = report.withColumn("problem", F.when(F.col("intervals") == 0, "empty").when(F.greatest("v4_share", "v6_share") > most, "covers too much"))
    return whole.join(report.where("problem is null").select("feed"), "feed", "left_semi"), report
