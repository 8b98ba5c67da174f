"""Queries over address ranges and published lists, made from the given tables, with
reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions.hosts import range_key
from clientlens.operators import intervals, network
from clientlens.sources import feeds

_V4 = 10 << 24


def _hex(n, digits: int):
    return F.lpad(F.lower(F.hex(n)), digits, "0")


def _ranges(spark, d) -> DataFrame:
    """Nested and overlapping ranges of both versions; all IPv6 ones in one /32."""
    n = F.col("c_custkey")
    size4, size6 = F.pow(F.lit(2), n % 18).cast("bigint"), F.pow(F.lit(2), n % 23).cast("bigint")
    lo4, lo6 = F.lit(_V4) + (n * 7919) % (1 << 24), (n * 104729) % (1 << 31)
    v4, pad = n % 3 != 0, "0" * 20 + "ffff"
    return spark.read.parquet(f"{d}/customer.parquet").select(
        (n % 40).cast("int").alias("rank"), F.concat(F.lit("net"), (n % 11).cast("string")).alias("name"), F.concat(F.lit("bot"), (n % 7).cast("string")).alias("agent"),
        F.when(v4, F.concat(F.lit(pad), _hex(lo4, 8))).otherwise(F.concat(F.lit("20010db8"), _hex(lo6, 8), F.lit("0" * 16))).alias("lo"),
        F.when(v4, F.concat(F.lit(pad), _hex(lo4 + size4 - 1, 8))).otherwise(F.concat(F.lit("20010db8"), _hex(lo6 + size6 - 1, 8), F.lit("f" * 16))).alias("hi"),
    )


def _points(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    n4, n6 = (k * 48271) % (1 << 24), (k * 69621) % (1 << 31)
    v4 = F.concat_ws(".", F.lit("10"), F.floor(n4 / 65536).cast("string"), (F.floor(n4 / 256) % 256).cast("string"), (n4 % 256).cast("string"))
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.floor(n6 / 65536).cast("bigint"))), F.lit(":"), F.lower(F.hex(n6 % 65536)), F.lit("::7"))
    ip = F.when(k % 2 == 0, v4).otherwise(v6)
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), ip.alias("client_ip"), F.concat(F.lit("bot"), (k % 7).cast("string")).alias("agent"))


def interval_join(spark, d) -> DataFrame:
    """The first range in rank that holds an address, by the sorted-range join."""
    p = _points(spark, d).withColumn("key", range_key(F.col("client_ip"))).select("id", "key")
    return intervals.first_range(p, _ranges(spark, d), small=0, per_slice=200).select("id", "rank", "name")


def own_ranges(spark, d) -> DataFrame:
    """Clients whose address lies in a range of the agent they name."""
    return network.in_own_ranges(_points(spark, d), _ranges(spark, d), "agent")


def merged_ranges(spark, d) -> DataFrame:
    """The fewest intervals of each network."""
    return intervals.merged(_ranges(spark, d), "name")


def _feeds(spark, d) -> DataFrame:
    """A list a nation, in one of the nine formats, of the prefixes of its customers."""
    n, g = F.col("c_custkey"), F.col("c_nationkey")
    bits = (32 - n % 12).cast("string")
    base = (n * 7919) % (1 << 24)
    cidr = F.concat_ws(".", F.lit("10"), F.floor(base / 65536).cast("string"), (F.floor(base / 256) % 256).cast("string"), F.concat((base % 256).cast("string"), F.lit("/"), bits))
    cidr = F.when(n % 50 == 0, F.concat(F.lit("10.1.2.3.4/"), bits)).otherwise(cidr)
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.concat(F.lit("feed"), g.cast("string")).alias("feed"), (g % 9).alias("k")).agg(F.collect_list(cidr).alias("p"))
    objects = lambda key: F.transform("p", lambda x: F.to_json(F.struct(x.alias(key))))
    j = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    quoted = F.transform("p", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    mixed = F.transform("p", lambda x, i: F.when(i % 2 == 0, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.to_json(F.struct(x.alias("ipv4Prefix")))))
    text = F.array(
        F.concat(F.lit('{"prefixes":'), j(mixed), F.lit("}")), F.concat(F.lit("<p>x</p><code class='a'>{&quot;prefixes&quot;:"), F.replace(j(objects("ip_prefix")), F.lit('"'), F.lit("&quot;")), F.lit("}</code>")),
        F.concat(F.lit('{"prefixes":'), j(objects("ip_prefix")), F.lit(',"ipv6_prefixes":7}')), F.concat(F.lit('{"values":[{"properties":{"addressPrefixes":'), j(quoted), F.lit("}},{}]}")),
        F.concat(F.lit("# list\n\n"), F.array_join("p", " # one\n")), F.concat(F.lit("prefix,country\n"), F.array_join("p", ",DE,x\n"), F.lit(",FR")),
        F.concat(F.lit('{"subnets":'), j(objects("ip_prefix")), F.lit("}")), F.concat(F.lit('{"regions":[{"cidrs":'), j(objects("cidr")), F.lit("}]}")),
        F.concat(F.lit('{"data":{"prefixes":'), j(objects("prefix")), F.lit("}}")),
    )
    kinds = F.array(*[F.lit(x) for x in ("prefixes", "amazon", "aws", "azure", "text", "csv", "subnets", "oracle", "ripestat")])
    return c.select("feed", F.get(kinds, F.col("k").cast("int")).alias("kind"), F.get(text, F.col("k").cast("int")).alias("text"))


def feed_intervals(spark, d) -> DataFrame:
    return feeds.feed_intervals(_feeds(spark, d), most=0.001)[0]


def feed_report(spark, d) -> DataFrame:
    return feeds.feed_intervals(_feeds(spark, d), most=0.001)[1].withColumn("v4_share", F.round("v4_share", 9))


def queries() -> dict:
    return {f.__name__: f for f in (interval_join, own_ranges, merged_ranges, feed_intervals, feed_report)}


_RANGES_SQL = f"""r AS (SELECT c_custkey AS n, (c_custkey % 40)::INT AS rank, 'net' || c_custkey % 11 AS name, 'bot' || c_custkey % 7 AS agent,
    CASE WHEN c_custkey % 3 <> 0 THEN repeat('0', 20) || 'ffff' || printf('%08x', {_V4} + (c_custkey * 7919) % 16777216) ELSE '20010db8' || printf('%08x', (c_custkey * 104729) % 2147483648) || repeat('0', 16) END AS lo,
    CASE WHEN c_custkey % 3 <> 0 THEN repeat('0', 20) || 'ffff' || printf('%08x', {_V4} + (c_custkey * 7919) % 16777216 + (1 << (c_custkey % 18)::INT) - 1) ELSE '20010db8' || printf('%08x', (c_custkey * 104729) % 2147483648 + (1 << (c_custkey % 23)::INT) - 1) || repeat('f', 16) END AS hi FROM customer),
  p AS (SELECT o_orderkey AS id, (o_orderkey * 48271) % 16777216 AS a, (o_orderkey * 69621) % 2147483648 AS b, 'bot' || o_orderkey % 7 AS agent FROM orders),
  q AS (SELECT *, CASE WHEN id % 2 = 0 THEN '10.' || a // 65536 || '.' || (a // 256) % 256 || '.' || a % 256 ELSE printf('2001:db8:%x:%x::7', b // 65536, b % 65536) END AS ip,
    CASE WHEN id % 2 = 0 THEN repeat('0', 20) || 'ffff' || printf('%08x', {_V4} + a) ELSE '20010db8' || printf('%08x', b) || repeat('0', 15) || '7' END AS key FROM p)"""
_FEEDS_SQL = f"""c AS (SELECT 'feed' || c_nationkey AS feed, c_custkey % 50 = 0 AS bad, 1 << (c_custkey % 12)::INT AS size, {_V4} + (c_custkey * 7919) % 16777216 AS ip FROM customer),
  b AS (SELECT feed, ip - ip % size AS lo, ip - ip % size + size - 1 AS hi FROM c WHERE NOT bad),
  m AS (SELECT feed, lo, hi, coalesce(lo > max(hi) OVER (PARTITION BY feed ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, TRUE) AS fresh FROM b),
  i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY feed ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m),
  w AS (SELECT feed, k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY feed, k),
  t AS (SELECT feed, count_if(NOT bad) AS prefixes, count_if(bad) AS malformed FROM c GROUP BY feed),
  s AS (SELECT feed, count(*) AS intervals, sum(hi - lo + 1) / 4294967296.0 AS share FROM w GROUP BY feed),
  rep AS (SELECT feed, prefixes, malformed, round(coalesce(share, 0.0), 9) AS v4_share, 0.0::DOUBLE AS v6_share, coalesce(intervals, 0) AS intervals, CASE WHEN coalesce(intervals, 0) = 0 THEN 'empty' WHEN share > 0.001 THEN 'covers too much' END AS problem FROM t LEFT JOIN s USING (feed))"""


def oracle_sql() -> dict[str, str]:
    pad = "repeat('0', 20) || 'ffff' || printf('%08x', {})"
    return {
        "interval_join": f"WITH {_RANGES_SQL} SELECT id, min({{'r': rank, 'n': name}}).r AS rank, min({{'r': rank, 'n': name}}).n AS name FROM q JOIN r ON key BETWEEN lo AND hi GROUP BY id",
        "own_ranges": f"WITH {_RANGES_SQL} SELECT DISTINCT q.agent, ip FROM q JOIN r ON key BETWEEN lo AND hi AND q.agent = r.agent",
        "merged_ranges": f"""WITH {_RANGES_SQL}, z AS (SELECT name, lo, hi, max(hi) OVER (PARTITION BY name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
            y AS (SELECT *, CASE WHEN reach IS NULL THEN 1 WHEN starts_with(lo, '2001') AND starts_with(reach, '2001') THEN (('0x' || substr(lo, 9, 8))::BIGINT > ('0x' || substr(reach, 9, 8))::BIGINT + 1)::INT WHEN starts_with(lo, '2001') THEN 1 ELSE (('0x' || substr(lo, 25, 8))::BIGINT > ('0x' || substr(reach, 25, 8))::BIGINT + 1)::INT END AS fresh FROM z),
            x AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM y) SELECT name, min(lo) AS lo, max(hi) AS hi FROM x GROUP BY name, k""",
        "feed_intervals": f"WITH {_FEEDS_SQL} SELECT feed, {pad.format('lo')} AS lo, {pad.format('hi')} AS hi FROM w JOIN rep USING (feed) WHERE problem IS NULL",
        "feed_report": f"WITH {_FEEDS_SQL} SELECT * FROM rep",
    }
