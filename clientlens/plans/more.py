"""Queries over log files written from the derived log, and over tables of answers,
with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.operators import clients, network, robots, rollup, verify
from clientlens.plans import census, derived
from clientlens.sources import logs, ordering
from clientlens.sources.shared import shared_folder

KEY = clients.KEY
RULES = "User-agent: *\nDisallow: /page*.html$\nDisallow: /shop/\nAllow: /shop/item2\nDisallow: /gone/*7\n"
CUSTOM = '%v:%p %a %t "%m %U%q %H" %s %b %D "%{X-Forwarded-For}i"'
BY_ASN = [(0, 7, "north", "provider"), (1, 7, "south", "provider"), (2, 9, "bird", "agent"), (3, 11, "east", "provider"), (4, 11, "bee", "agent")]


def scratch(spark) -> str:
    return shared_folder(spark, "log")


def written(spark, d, line: str, **options) -> str:
    path = scratch(spark)
    e = derived.log(spark, d).withColumn("t", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"))
    e.selectExpr(f"CASE WHEN seq % 97 = 0 THEN 'not a line' ELSE {line} END AS value").write.text(path, **options)
    return path


_PLAIN = """concat(remote_host, ' - ', CASE WHEN seq % 5 = 0 THEN 'bob' ELSE '-' END, ' [', t, ' +0000] "', method, ' ', path, coalesce(concat('?', query), ''), ' HTTP/1.1" ',
  status, ' ', CASE WHEN seq % 11 = 0 THEN '-' ELSE CAST(bytes_sent AS STRING) END, ' "', coalesce(referer, '-'), '" "', user_agent, CASE WHEN seq % 13 = 0 THEN ' \\\\"x\\\\"' ELSE '' END, '"')"""


def apache_entries(spark, d) -> DataFrame:
    e = logs.read_log(spark, [written(spark, d, _PLAIN)])
    return e.select("remote_host", "remote_logname", "remote_user", "ts", "method", "path", "query", "protocol", "status", "bytes_sent", "referer", "user_agent", "skip_reason")


def apache_pooled(spark, d) -> DataFrame:
    """A folder of .gz files given twice, with blank lines between."""
    path = written(spark, d, f"concat({_PLAIN}, '\n\n  ')", compression="gzip")
    return logs.skip_counts(logs.read_log(spark, [path, path]))


def custom_format(spark, d) -> DataFrame:
    line = """concat('Site', seq % 3, '.org:443 ', remote_host, ' [', t, ' +0000] "', method, ' ', path, coalesce(concat('?', query), ''), ' HTTP/2" ', status, ' ', bytes_sent, ' ', seq % 1000,
      ' "', CASE seq % 3 WHEN 0 THEN '-' WHEN 1 THEN '198.51.100.7, 10.0.0.1' ELSE ' , 203.0.113.9 ,' END, '"')"""
    e = logs.read_log(spark, [written(spark, d, line)], CUSTOM)
    return e.select("server_name", "remote_host", "ts", "method", "path", "query", "protocol", "status", "bytes_sent", "response_usec", F.array_join("forwarded_for", "|").alias("hops"), "skip_reason")


def cloudflare_entries(spark, d) -> DataFrame:
    e = derived.log(spark, d)
    us = F.unix_micros("ts")
    time = F.when(F.col("seq") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("seq") % 3 == 1, (us * 1000).cast("string")).otherwise(F.floor(us / 1000).cast("string"))
    line = F.to_json(F.struct(
        F.col("remote_host").alias("ClientIP"), F.col("method").alias("ClientRequestMethod"), F.concat("path", F.coalesce(F.concat(F.lit("?"), "query"), F.lit(""))).alias("ClientRequestURI"),
        F.col("host_header").alias("ClientRequestHost"), F.col("referer").alias("ClientRequestReferer"), F.col("user_agent").alias("ClientRequestUserAgent"), F.lit("HTTPS").alias("ClientRequestScheme"),
        F.col("status").alias("EdgeResponseStatus"), F.col("bytes_sent").alias("EdgeResponseBytes"), time.alias("EdgeStartTimestamp"), (F.col("seq") % 50).alias("ClientASN"),
    ))
    path = scratch(spark)
    e.select(F.when(F.col("seq") % 89 == 0, "{broken").otherwise(line).alias("value")).write.text(path)
    out = logs.read_log(spark, [path], source="cloudflare")
    return out.select("remote_host", "ts", "method", "path", "query", "status", "bytes_sent", "referer", "user_agent", "host_header", "scheme", F.col("extra")["asn"].alias("asn"), "skip_reason")


def file_order(spark, d) -> DataFrame:
    """Files by day, the window the last ten days of the log."""
    e = derived.log(spark, d)
    name = F.concat(F.lit("log."), F.dayofmonth("ts").cast("string"), F.when(F.dayofmonth("ts") % 4 == 0, ".gz").otherwise(""))
    lines = e.select(name.alias("file"), "seq", F.when(F.dayofmonth("ts") != 13, F.col("ts")).alias("ts"))
    lines = lines.withColumn("line", F.row_number().over(clients.Window.partitionBy("file").orderBy("seq")) - 1)
    return ordering.order_files(ordering.spans(lines), 10 * 86400.0)


def _claims(spark, d) -> DataFrame:
    n = F.col("c_custkey")
    none = F.array().cast("array<string>")
    two = F.array(F.lit("crawl.example"), F.lit("bot.example"))
    return spark.read.parquet(f"{d}/customer.parquet").select(
        n.alias("id"), F.concat(F.lit("10.0."), (n % 200).cast("string"), F.lit("."), (n % 250).cast("string")).alias("client_ip"), F.lit("examplebot").alias("agent_token"),
        F.when(n % 6 == 5, None).otherwise(n % 4 + 6).cast("bigint").alias("as_number"), F.when(n % 4 != 0, two).otherwise(none).alias("domains"),
        F.when(n % 5 == 1, F.array(F.lit(7).cast("bigint"), F.lit(9).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("asns"), (n % 3 != 0).alias("has_ranges"),
        F.when(n % 7 != 0, n % 2 == 0).alias("inside"), (n % 5 != 2).alias("complete"), (n % 11 == 3).alias("fallback"),
    )


def _answers(spark, d) -> DataFrame:
    c = _claims(spark, d).select("client_ip").distinct()
    n = F.split("client_ip", r"\.")[3].cast("int")
    host = F.when(n % 4 == 1, F.lit("a.Crawl.example.")).when(n % 4 == 2, F.lit("evil.test")).when(n % 4 == 3, F.lit("bot.example"))
    forward = F.when(n % 3 == 0, F.array("client_ip")).when(n % 3 == 1, F.array(F.lit("192.0.2.1"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("client_ip").alias("ip"), host.alias("host"), (n % 8 == 0).alias("no_record"), forward.alias("forward"))


def verification(spark, d) -> DataFrame:
    return verify.verify(_claims(spark, d), _answers(spark, d)).select("id", "range_state", "dns_state", "status", "domain")


def verified_operators(spark, d) -> DataFrame:
    v = verify.verify(_claims(spark, d), _answers(spark, d)).withColumns({"requests": F.col("id") % 10, "total_bytes": F.col("id"), "first_seen": F.col("id"), "last_seen": F.col("id")})
    return verify.merge_verified(v).select("domain", "agent_token", F.size("member_ips").alias("members"), F.array_join("member_ips", ",").alias("ips"), "requests", "total_bytes", "first_seen", "last_seen")


def provider_by_as(spark, d) -> DataFrame:
    c = verify.verify(_claims(spark, d), _answers(spark, d)).withColumn("hosting", F.when(F.col("id") % 13 == 0, "ranged"))
    c = c.withColumn("as_number", network.resolve_as(F.when(F.col("id") % 17 == 0, 11), F.lit(None), F.col("as_number"), F.lit(9)))
    c = c.withColumnRenamed("domain", "verified_domain")
    return network.provider(c, spark.createDataFrame(BY_ASN, "rank int, asn bigint, name string, role string")).select("id", "as_number", "network", "category")


def route_members(spark, d) -> DataFrame:
    from clientlens.plans import queries as q

    r = q._ranges(spark)
    e = census.attributed(derived.log(spark, d), r.where("name = 'beta'"), r.where("name = 'gamma'"))
    return e.groupBy("route", *KEY).agg(F.array_join(F.array_sort(F.collect_set("remote_host")), ",").alias("members"))


def identity_stats(spark, d) -> DataFrame:
    e = clients.with_client(derived.log(spark, d))
    return rollup.identity_stats(e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("requests")), e)


def referer_sides(spark, d) -> DataFrame:
    f = clients.features(clients.with_client(derived.log(spark, d)))
    return f.select(*KEY, "referers", "self_referers", "followed", "www_referers", "apex_referers", F.col("robots_first").cast("int").alias("robots_first"))


def probe_samples(spark, d) -> DataFrame:
    """The feature is the limit: the first five different probe paths of a client."""
    return clients.first_paths(census.flagged(derived.log(spark, d)).where("probe"), 5).select(*KEY, F.array_join("paths", " ").alias("paths"))


def client_trace(spark, d) -> DataFrame:
    """The feature is the limit: the first ten entries of a client."""
    return clients.trace(census.flagged(derived.log(spark, d)), 10).select(*KEY, "place", "seq", "target", "status")


def method_counts(spark, d) -> DataFrame:
    return census.flagged(derived.log(spark, d)).groupBy(*KEY, "method").agg(F.count(F.lit(1)).alias("requests"))


def redirect_decision(spark, d) -> DataFrame:
    e = derived.log(spark, d)
    e = e.withColumn("status", F.when((F.col("host_header") == "Example.org") & (F.col("seq") % 20 != 0), 301).otherwise(F.col("status")))
    return network.redirect_shadow(network.redirect_sides(census.flagged(e)))


def robots_patterns(spark, d) -> DataFrame:
    e = census.flagged(derived.log(spark, d)).withColumn("product", F.lit(None).cast("string"))
    return robots.compliance(e, robots.parse(RULES), KEY)


def kind_cadence(spark, d) -> DataFrame:
    e = clients.with_client(derived.log(spark, d))
    c = clients.features(e).withColumn("kind", F.when(F.col("page_count") > 10, "wide").otherwise("narrow"))
    return rollup.kind_cadence(c, clients.request_buckets(e))


def forwarded_identity(spark, d) -> DataFrame:
    e = derived.log(spark, d).withColumn("forwarded_for", F.when(F.col("seq") % 4 == 0, F.array(F.concat(F.lit("198.51.100."), (F.col("seq") % 9).cast("string")))).otherwise(F.array().cast("array<string>")))
    return clients.with_client(e, "forwarded").groupBy(*KEY).agg(F.count(F.lit(1)).alias("requests"))


def queries() -> dict:
    own = (
        apache_entries, apache_pooled, custom_format, cloudflare_entries, file_order, verification, verified_operators, provider_by_as, route_members, identity_stats,
        referer_sides, probe_samples, client_trace, method_counts, redirect_decision, robots_patterns, kind_cadence, forwarded_identity,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from clientlens.plans import queries as q

    key = "client_ip, client_ua"
    log = f"log AS ({derived.SQL})"
    bad = "seq % 97 = 0"
    ok = lambda e, c: f"CASE WHEN NOT ({bad}) THEN {e} END AS {c}"
    second = "date_trunc('second', ts)"
    claims = f"""claims AS (SELECT c_custkey AS id, '10.0.' || c_custkey % 200 || '.' || c_custkey % 250 AS client_ip, CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 4 + 6 END AS asn, c_custkey % 4 <> 0 AS named,
        c_custkey % 5 = 1 AS listed, c_custkey % 3 <> 0 AS ranged, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS inside, c_custkey % 5 <> 2 AS complete, c_custkey % 11 = 3 AS fallback, c_custkey % 250 AS n FROM customer),
      states AS (SELECT *, CASE WHEN ranged THEN CASE WHEN coalesce(inside, FALSE) THEN 'pass' WHEN complete THEN 'fail' ELSE 'unknown' END END AS range_state,
        CASE WHEN named THEN CASE n % 4 WHEN 2 THEN 'fail' WHEN 0 THEN CASE WHEN n % 8 = 0 THEN 'fail' ELSE 'unknown' END ELSE CASE n % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END END END AS dns_state FROM claims),
      net AS (SELECT *, CASE WHEN range_state IS NOT NULL AND dns_state IS NOT NULL THEN CASE WHEN fallback THEN CASE WHEN range_state = 'unknown' THEN dns_state ELSE range_state END
          WHEN 'fail' IN (range_state, dns_state) THEN 'fail' WHEN range_state = 'pass' AND dns_state = 'pass' THEN 'pass' ELSE 'unknown' END ELSE coalesce(range_state, dns_state, 'unknown') END AS merged FROM states),
      v AS (SELECT *, CASE WHEN merged = 'pass' THEN 'verified' WHEN listed AND asn IN (7, 9) THEN 'asn-associated' WHEN listed AND asn IS NOT NULL THEN 'impersonator' WHEN merged = 'fail' THEN 'impersonator' ELSE 'unverified' END AS status FROM net),
      w AS (SELECT *, CASE WHEN status = 'verified' THEN CASE WHEN named THEN CASE WHEN n % 4 = 3 THEN 'bot.example' ELSE 'crawl.example' END ELSE CASE n % 4 WHEN 1 THEN 'a.Crawl.example.' WHEN 2 THEN 'evil.test' WHEN 3 THEN 'bot.example' ELSE 'verified' END END END AS domain FROM v)"""
    name = "'log.' || day(ts) || CASE WHEN day(ts) % 4 = 0 THEN '.gz' ELSE '' END"
    flags, ordered, features = q.FLAGS, q.ORDERED, q.FEATURES
    hit = "regexp_matches(path, '^/page.*\\.html$') OR (starts_with(path, '/shop/') AND NOT starts_with(path, '/shop/item2')) OR regexp_matches(path, '^/gone/.*7')"
    return {
        "apache_entries": f"""WITH {log} SELECT {ok('remote_host', 'remote_host')}, NULL::VARCHAR AS remote_logname, {ok("CASE WHEN seq % 5 = 0 THEN 'bob' END", 'remote_user')}, {ok(second, 'ts')}, {ok('method', 'method')}, {ok('path', 'path')},
            {ok('query', 'query')}, {ok("'HTTP/1.1'", 'protocol')}, {ok('status', 'status')}, {ok('CASE WHEN seq % 11 = 0 THEN 0 ELSE bytes_sent END', 'bytes_sent')}, {ok('referer', 'referer')},
            {ok("user_agent || CASE WHEN seq % 13 = 0 THEN ' " + '"x"' + "' ELSE '' END", 'user_agent')}, CASE WHEN {bad} THEN 'unmatched_line' END AS skip_reason FROM log""",
        "apache_pooled": f"WITH {log} SELECT 2 * count(*) AS total, 2 * count_if(NOT ({bad})) AS parsed, 2 * count_if({bad}) AS skipped, 0::BIGINT AS out_of_window, 0::BIGINT AS excluded, 0::BIGINT AS untimed, 'not a line' AS first_skipped FROM log",
        "custom_format": f"""WITH {log} SELECT {ok("'Site' || seq % 3 || '.org'", 'server_name')}, {ok('remote_host', 'remote_host')}, {ok(second, 'ts')}, {ok('method', 'method')}, {ok('path', 'path')}, {ok('query', 'query')}, {ok("'HTTP/2'", 'protocol')},
            {ok('status', 'status')}, {ok('bytes_sent', 'bytes_sent')}, {ok('seq % 1000', 'response_usec')}, {ok("CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN '198.51.100.7|10.0.0.1' ELSE '203.0.113.9' END", 'hops')}, CASE WHEN {bad} THEN 'unmatched_line' END AS skip_reason FROM log""",
        "cloudflare_entries": f"""WITH {log}, g AS (SELECT *, seq % 89 = 0 AS bad FROM log) SELECT CASE WHEN NOT bad THEN remote_host END AS remote_host, CASE WHEN NOT bad THEN CASE WHEN seq % 3 = 2 THEN date_trunc('millisecond', ts) ELSE ts END END AS ts,
            CASE WHEN NOT bad THEN method END AS method, CASE WHEN bad THEN '' ELSE path END AS path, CASE WHEN NOT bad THEN query END AS query, CASE WHEN NOT bad THEN status END AS status, CASE WHEN NOT bad THEN bytes_sent END AS bytes_sent,
            CASE WHEN NOT bad THEN referer END AS referer, CASE WHEN NOT bad THEN user_agent END AS user_agent, CASE WHEN NOT bad THEN host_header END AS host_header, CASE WHEN NOT bad THEN 'https' END AS scheme,
            CASE WHEN NOT bad THEN (seq % 50)::VARCHAR END AS asn, CASE WHEN bad THEN 'invalid_json' END AS skip_reason FROM g""",
        "file_order": f"""WITH {log}, l AS (SELECT {name} AS file, CASE WHEN day(ts) <> 13 THEN ts END AS ts, row_number() OVER (PARTITION BY {name} ORDER BY seq) - 1 AS line FROM log),
            s AS (SELECT file, arg_min(ts, line) FILTER (line < 256 AND ts IS NOT NULL) AS first, CASE WHEN file NOT LIKE '%.gz' THEN arg_max(ts, line) FILTER (ts IS NOT NULL) END AS last FROM l GROUP BY file),
            o AS (SELECT *, row_number() OVER w AS place, coalesce(last, lead(first) OVER w) AS upper, max(coalesce(last, first)) OVER () - INTERVAL 10 DAY AS window_start FROM s WINDOW w AS (ORDER BY first IS NOT NULL, first, file))
            SELECT file, place, window_start, NOT (first IS NOT NULL AND coalesce(upper < window_start, FALSE)) AS kept FROM o""",
        "verification": f"WITH {claims} SELECT id, range_state, dns_state, status, domain FROM w",
        "verified_operators": f"WITH {claims} SELECT domain, 'examplebot' AS agent_token, count(DISTINCT client_ip)::INT AS members, array_to_string(list_sort(list(DISTINCT client_ip)), ',') AS ips, sum(id % 10)::BIGINT AS requests, sum(id)::BIGINT AS total_bytes, min(id) AS first_seen, max(id) AS last_seen FROM w WHERE status = 'verified' GROUP BY domain",
        "provider_by_as": f"""WITH {claims}, z AS (SELECT *, CASE WHEN id % 17 = 0 THEN 11 ELSE coalesce(asn, 9) END AS as_number FROM w)
            SELECT id, as_number, coalesce(CASE WHEN id % 13 = 0 THEN 'ranged' END, CASE as_number WHEN 7 THEN 'north' WHEN 11 THEN 'east' END, CASE as_number WHEN 9 THEN 'bird' WHEN 11 THEN 'bee' END, domain, 'Residential / unknown') AS network,
            CASE WHEN id % 13 = 0 OR as_number IN (7, 9, 11) OR domain IS NOT NULL THEN 'datacenter' ELSE 'residential' END AS category FROM z""",
        "route_members": q.reference()["route_fold"].replace("count(*) AS requests, count(DISTINCT remote_host) AS members", "array_to_string(list_sort(list(DISTINCT remote_host)), ',') AS members"),
        "identity_stats": f"WITH {log}, c AS (SELECT remote_host, user_agent, count(*) AS n FROM log GROUP BY ALL), u AS (SELECT remote_host, count(DISTINCT user_agent) + max((user_agent IS NULL)::INT) AS n FROM log GROUP BY 1) SELECT (SELECT count(*) FROM c) AS client_count, (SELECT count_if(n = 1) FROM c) AS singletons, (SELECT count_if(n > 1) FROM u) AS ips_with_multiple_uas",
        "referer_sides": f"""WITH {flags}, {ordered}, rs AS (SELECT {key}, min(CASE WHEN NOT robots_file THEN seq END) AS c0, min(CASE WHEN robots_file THEN seq END) AS r0 FROM f GROUP BY ALL),
            z AS (SELECT {key}, count_if(referer <> '') AS referers, count_if(self_ref) AS self_referers, count_if(followed_) AS followed,
              count_if(regexp_replace(ref_host, '^www\\.', '') = site AND starts_with(ref_host, 'www.')) AS www_referers, count_if(regexp_replace(ref_host, '^www\\.', '') = site AND NOT starts_with(ref_host, 'www.')) AS apex_referers FROM g GROUP BY ALL)
            SELECT z.*, coalesce(r0 < coalesce(c0, r0 + 1), FALSE)::INT AS robots_first FROM z JOIN rs ON z.client_ip = rs.client_ip AND z.client_ua IS NOT DISTINCT FROM rs.client_ua""",
        "probe_samples": f"WITH {flags}, p AS (SELECT {key}, path, min(seq) AS s FROM f WHERE probe GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s) AS i FROM p) SELECT {key}, string_agg(path, ' ' ORDER BY i) AS paths FROM o WHERE i <= 5 GROUP BY ALL",
        "client_trace": f"WITH {flags}, o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS place FROM f) SELECT {key}, place, seq, target, status FROM o WHERE place <= 10",
        "method_counts": f"WITH {log} SELECT remote_host AS client_ip, user_agent AS client_ua, method, count(*) AS requests FROM log GROUP BY ALL",
        "redirect_decision": f"""WITH log0 AS ({derived.SQL}), s AS (SELECT regexp_replace(lower(split_part(host_header, ':', 1)), '^www\\.', '') AS site, starts_with(lower(host_header), 'www.') AS www, CASE WHEN host_header = 'Example.org' AND seq % 20 <> 0 THEN 301 ELSE status END BETWEEN 300 AND 399 AS red, seq FROM log0),
            z AS (SELECT site, count(*) AS n, min(seq) AS f, count_if(www) AS w, count_if(www AND red) AS wr, count_if(NOT www) AS b, count_if(NOT www AND red) AS br FROM s GROUP BY site ORDER BY n DESC, f LIMIT 1)
            SELECT site, CASE WHEN w >= 50 AND wr >= w * 0.9 AND NOT (b >= 50 AND br >= b * 0.9) THEN 'www' WHEN b >= 50 AND br >= b * 0.9 AND NOT (w >= 50 AND wr >= w * 0.9) THEN 'apex' END AS shadow FROM z""",
        "robots_patterns": f"WITH {flags}, b AS (SELECT *, NOT robots_file AND ({hit}) AS bad FROM f) SELECT {key}, count_if(bad) AS disallowed_hits, CASE WHEN count_if(bad) > 0 THEN 'ignores' WHEN bool_or(robots_file) OR count(*) >= 5 THEN 'respects' ELSE 'unknown' END AS verdict FROM b GROUP BY ALL",
        "kind_cadence": f"""WITH {flags}, {ordered}, {features}, w AS (SELECT {key}, epoch_us(ts) // 60000000 AS m, min(epoch_us(ts) // 60000000) OVER (PARTITION BY {key}) AS lo, max(epoch_us(ts) // 60000000) OVER (PARTITION BY {key}) AS hi FROM f),
            b AS (SELECT client_ip AS bi, client_ua AS bu, least(((m - lo) * 40) // (hi - lo), 39) AS bucket, count(*) AS hits FROM w WHERE hi > lo GROUP BY ALL),
            j AS (SELECT CASE WHEN page_count > 10 THEN 'wide' ELSE 'narrow' END AS kind, CASE WHEN bucket IS NULL THEN epoch_us(first_seen) / 1e6 ELSE epoch_us(first_seen) / 1e6 + (bucket + 0.5) / 40 * duration END AS at_, coalesce(hits, requests) AS h
              FROM q LEFT JOIN b ON client_ip = bi AND client_ua IS NOT DISTINCT FROM bu) SELECT kind, (floor(at_ / 300) * 300)::BIGINT AS slot, sum(h)::BIGINT AS requests FROM j GROUP BY ALL""",
        "forwarded_identity": f"WITH {log} SELECT CASE WHEN seq % 4 = 0 THEN '198.51.100.' || seq % 9 ELSE remote_host END AS client_ip, user_agent AS client_ua, count(*) AS requests FROM log GROUP BY ALL",
    }
