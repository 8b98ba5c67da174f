"""Queries of traces, patterns and digests over the derived log, with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions.agents import agent_profile
from clientlens.operators import calibrate, clients, inspect, robots, rollup
from clientlens.plans import census, derived

KEY = clients.KEY


def _flagged(spark, d) -> DataFrame:
    return census.flagged(derived.log(spark, d))


def trace_forest(spark, d) -> DataFrame:
    """The feature is the limit: the first sixty entries of each client, as a forest."""
    # assets name the page before them in the made log's third part, so that some nest
    e = _flagged(spark, d).withColumn("ref_path", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("/static/a"), (F.col("seq") % 10).cast("string"), F.lit(".css"))).otherwise(F.col("ref_path")))
    return inspect.cascade(clients.trace(e, 60).drop("place")).select(*KEY, "seq", "place", "page", "depth", F.round("offset", 3).alias("offset"))


def _placed(spark, d):
    e = _flagged(spark, d)
    c = e.groupBy(*KEY).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"))
    c = c.withColumn("duration", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6)
    return e, c


def shared_axis(spark, d) -> DataFrame:
    e, c = _placed(spark, d)
    return inspect.on_axis(c, clients.request_buckets(e))


def actor_patterns(spark, d) -> DataFrame:
    e, c = _placed(spark, d)
    return inspect.patterns(inspect.on_axis(c, clients.request_buckets(e)), c.withColumn("actor", F.coalesce("client_ua", F.lit(""))))


def kind_patterns(spark, d) -> DataFrame:
    e, c = _placed(spark, d)
    c = c.withColumn("kind", F.when(F.col("requests") > 60, "busy").otherwise("quiet"))
    return inspect.kinds_on_axis(rollup.kind_cadence(c, clients.request_buckets(e)), c)


def _digest_clients(spark, d) -> DataFrame:
    n = F.col("c_custkey")
    tags = F.array_compact(F.array(F.when(n % 3 == 0, "declares-known-bot"), F.when(n % 4 == 0, "bot-ua"), F.when(n % 9 == 0, "dns-verified"), F.when(n % 7 == 0, "traversal"), F.when(n % 6 == 0, "forged-referer")))
    kind = F.when(n % 13 == 0, "impersonator").when(n % 5 == 0, "crawler").when(n % 5 == 1, "scraper").otherwise("unknown")
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("ua"), (n % 83).cast("string")).alias("user_agent"), (n * 17 % 101 + 1).alias("requests"), kind.alias("kind"), tags.alias("tags"),
        F.when(n % 8 != 0, n % 61).alias("as_number"), (n % 2 == 0).alias("datacenter"),
    )


def calibration(spark, d) -> DataFrame:
    return calibrate.digest(_digest_clients(spark, d), 10)


def country_majority(spark, d) -> DataFrame:
    """A fold's country from its addresses, ties without one."""
    n = F.col("o_orderkey")
    m = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("fold"), (F.col("o_custkey") % 500).cast("string")).alias("client_ip"), F.lit(None).cast("string").alias("client_ua"), n.cast("string").alias("ip"))
    countries = spark.read.parquet(f"{d}/orders.parquet").select(n.cast("string").alias("ip"), F.when(n % 5 != 0, F.element_at(F.array(*map(F.lit, ("DE", "FR", "DE", "SE"))), (n % 4 + 1).cast("int"))).alias("country"), (n % 7 == 0).alias("suppressed"))
    return calibrate.member_countries(m, countries).select("client_ip", "country")


def site_majority(spark, d) -> DataFrame:
    return calibrate.site_host(_flagged(spark, d))


DELAYS = "User-agent: Google\nCrawl-delay: 5\n\nUser-agent: Googlebot\nCrawl-delay: 900\nDisallow: /x\n\nUser-agent: *\nCrawl-delay: 60\nUser-agent: GPTBot\nDisallow: /\n"


def crawl_delay(spark, d) -> DataFrame:
    e = clients.with_client(derived.log(spark, d))
    said = agent_profile(e).select(F.col("user_agent").alias("_u"), "product")
    o = clients.ordered(e)
    f = census.joined(o.groupBy(*KEY).agg(F.count(F.lit(1)).alias("requests")), clients.gaps(o), KEY)  # measures other than gaps are not asked for
    f = f.join(said, F.col("client_ua").eqNullSafe(F.col("_u")), "left")
    return robots.with_delay(f, DELAYS).select(*KEY, "crawl_delay", "matched_group", F.col("delay_respected").cast("int").alias("delay_respected"))


def queries() -> dict:
    return {f.__name__: f for f in (crawl_delay, trace_forest, shared_axis, actor_patterns, kind_patterns, calibration, country_majority, site_majority)}


def oracle_sql() -> dict[str, str]:
    from clientlens.plans import queries as q

    log = f"log AS ({derived.SQL})"
    key = "client_ip, client_ua"
    same = lambda a, b: f"{a}.client_ip = {b}.client_ip AND {a}.client_ua IS NOT DISTINCT FROM {b}.client_ua"
    placed = f"""{log}, e AS (SELECT remote_host AS client_ip, user_agent AS client_ua, epoch_us(ts) AS us FROM log),
      c AS (SELECT {key}, min(us) AS a, max(us) AS b, count(*) AS n FROM e GROUP BY ALL),
      m AS (SELECT {key}, us // 60000000 AS m, min(us // 60000000) OVER (PARTITION BY {key}) AS lo, max(us // 60000000) OVER (PARTITION BY {key}) AS hi FROM e),
      k AS (SELECT {key}, least(((m - lo) * 40) // (hi - lo), 39) AS bucket, count(*) AS hits FROM m WHERE hi > lo GROUP BY ALL),
      w AS (SELECT min(a) / 1e6 AS w0, (max(b) - min(a)) / 1e6 AS w1 FROM c),
      p AS (SELECT c.client_ip, c.client_ua, c.n, CASE WHEN bucket IS NULL THEN a / 1e6 ELSE a / 1e6 + (bucket + 0.5) / 40 * ((b - a) / 1e6) END AS at_, coalesce(hits, n) AS h FROM c LEFT JOIN k ON {same('c', 'k')}),
      x AS (SELECT client_ip, client_ua, least(greatest(floor((at_ - w0) / w1 * 40), 0), 39)::INT AS slot, sum(h)::BIGINT AS requests FROM p, w GROUP BY ALL)"""
    customers = """c AS (SELECT c_custkey AS n, 'ua' || c_custkey % 83 AS ua, c_custkey * 17 % 101 + 1 AS req, CASE WHEN c_custkey % 13 = 0 THEN 'impersonator' WHEN c_custkey % 5 = 0 THEN 'crawler' WHEN c_custkey % 5 = 1 THEN 'scraper' ELSE 'unknown' END AS kind FROM customer),
      s AS (SELECT CASE WHEN n % 3 = 0 THEN CASE WHEN n % 9 <> 0 THEN 'recognised, unverified' END WHEN n % 4 = 0 THEN 'unrecognised bots' END AS section, ua AS key, req, kind, ua FROM c
        UNION ALL SELECT 'unrecognised ASes', (n % 61)::VARCHAR, req, kind, ua FROM c WHERE n % 2 = 1
        UNION ALL SELECT 'suspect', 'traversal', req, kind, ua FROM c WHERE n % 7 = 0 UNION ALL SELECT 'suspect', 'forged-referer', req, kind, ua FROM c WHERE n % 6 = 0 UNION ALL SELECT 'suspect', 'impersonator', req, kind, ua FROM c WHERE kind = 'impersonator'),
      g AS (SELECT section, key, sum(req)::BIGINT AS requests, count(*) AS clients FROM s WHERE section IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY requests DESC, key) AS place, count(*) OVER (PARTITION BY section) AS total FROM g)"""
    best = lambda col: f"""(SELECT section, key, string_agg(v || ' x' || n, ', ' ORDER BY i) AS t FROM (SELECT section, key, {col} AS v, count(*) AS n, row_number() OVER (PARTITION BY section, key ORDER BY count(*) DESC, {col}) AS i FROM s GROUP BY section, key, {col}) WHERE i <= 3 GROUP BY section, key)"""
    return {
        "trace_forest": f"""WITH RECURSIVE {q.FLAGS}, t AS (SELECT client_ip, client_ua, seq, ts, static, path, CASE WHEN seq % 3 = 0 THEN '/static/a' || seq % 10 || '.css' ELSE ref_path END AS ref, referer <> '' AS has, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS i0 FROM f),
            o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts IS NULL, ts, seq) AS place, sum((NOT static)::INT) OVER (PARTITION BY {key} ORDER BY ts IS NULL, ts, seq ROWS UNBOUNDED PRECEDING) AS page FROM t WHERE i0 <= 60),
            z AS (SELECT client_ip, client_ua, place, CASE WHEN static THEN []::VARCHAR[] ELSE [path] END AS paths, CASE WHEN static THEN []::INT[] ELSE [0] END AS depths, 0 AS depth FROM o WHERE place = 1
              UNION ALL
              SELECT client_ip, client_ua, place, CASE WHEN NOT static THEN [path] WHEN d > 0 AND NOT list_contains(paths, path) THEN list_append(paths, path) ELSE paths END,
                CASE WHEN NOT static THEN [0] WHEN d > 0 AND NOT list_contains(paths, path) THEN list_append(depths, d) ELSE depths END, d
              FROM (SELECT o.*, z.paths, z.depths, CASE WHEN o.static AND coalesce(o.has, FALSE) AND list_contains(z.paths, o.ref) THEN z.depths[list_position(z.paths, o.ref)] + 1 ELSE 0 END AS d FROM z JOIN o ON {same('z', 'o')} AND o.place = z.place + 1)),
            y AS (SELECT o.*, z.depth FROM o JOIN z ON {same('o', 'z')} AND o.place = z.place)
            SELECT client_ip, client_ua, seq, place::INT AS place, page::BIGINT AS page, depth::INT AS depth, round((epoch_us(ts) - epoch_us(CASE WHEN depth > 0 THEN last_value(CASE WHEN NOT static THEN ts END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY place ROWS UNBOUNDED PRECEDING)
              ELSE coalesce(last_value(CASE WHEN depth = 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) END)) / 1e6, 3) AS "offset" FROM y""",
        "shared_axis": f"WITH {placed} SELECT * FROM x",
        "actor_patterns": f"WITH {placed}, y AS (SELECT coalesce(client_ua, '') AS actor, slot, sum(requests)::BIGINT AS requests FROM x GROUP BY ALL) SELECT *, max(requests) OVER () AS peak FROM y",
        "kind_patterns": f"""WITH {placed}, y AS (SELECT CASE WHEN n > 60 THEN 'busy' ELSE 'quiet' END AS kind, floor(at_ / 300) * 300 AS cell, sum(h) AS h FROM p GROUP BY ALL)
            SELECT kind, least(greatest(floor((cell + 150 - w0) / w1 * 40), 0), 39)::INT AS slot, sum(h)::BIGINT AS requests FROM y, w GROUP BY ALL""",
        "calibration": f"WITH {customers} SELECT r.section, place::INT AS place, r.key, requests, clients, a.t AS kinds, b.t AS agents, greatest(total - 10, 0) AS more FROM r JOIN {best('kind')} a ON r.section = a.section AND r.key = a.key JOIN {best('ua')} b ON r.section = b.section AND r.key = b.key WHERE place <= 10",
        "country_majority": """WITH v AS (SELECT 'fold' || o_custkey % 500 AS client_ip, ['DE', 'FR', 'DE', 'SE'][o_orderkey % 4 + 1] AS country FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0),
            n AS (SELECT client_ip, country, count(*) AS n FROM v GROUP BY client_ip, country), t AS (SELECT client_ip, count(*) AS total FROM v GROUP BY client_ip) SELECT client_ip, country FROM n JOIN t USING (client_ip) WHERE n * 2 > total""",
        "crawl_delay": f"""WITH {q.FLAGS}, {q.ORDERED}, {q.FEATURES}, dly AS (SELECT {key}, CASE WHEN iat_n <= 256 THEN med ELSE {q._binned('0.5')} END AS med_, CASE WHEN contains(client_ua, 'Googlebot') THEN 5.0 WHEN contains(client_ua, 'GPTBot') THEN NULL ELSE 60.0 END::DOUBLE AS crawl_delay,
            CASE WHEN contains(client_ua, 'Googlebot') THEN 'Google' WHEN contains(client_ua, 'GPTBot') THEN 'GPTBot' ELSE '*' END AS matched_group FROM q) SELECT {key}, crawl_delay, matched_group, (med_ >= crawl_delay)::INT AS delay_respected FROM dly""",
        "site_majority": f"WITH {q.FLAGS}, n AS (SELECT ref_host, count(*) AS n FROM f WHERE ref_host IS NOT NULL GROUP BY ref_host) SELECT ref_host AS site FROM n WHERE n * 2 > (SELECT sum(n) FROM n)",
    }
