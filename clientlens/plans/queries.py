"""Queries over the derived log, with reference SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.agents import agent_profile, version_band
from clientlens.functions.hosts import bare_host, referer_host, site_key
from clientlens.operators import classify, clients, network, robots, rollup
from clientlens.plans import census, derived, more, ranges, runs, signed, views
from clientlens.sources import logs

KEY = clients.KEY
ROBOTS = "User-agent: *\nDisallow: /shop/\nAllow: /shop/item1\n\nUser-agent: GPTBot\nDisallow: /\n"
CIDRS = [(0, "alpha", "10.0.0.0/19"), (1, "beta", "10.0.16.0/20"), (2, "gamma", "10.1.0.0/16"), (3, "delta", "10.0.0.0/8")]


def _flagged(spark, d):
    return census.flagged(derived.log(spark, d))


def _entries(spark, d):
    """Entries whose flags are set after their exchange."""
    return clients.with_client(derived.log(spark, d))


def _r(c, n=6):
    return F.round(c, n)


def entry_flags(spark, d) -> DataFrame:
    flags = ["static", "page", "feed", "probe", "submit", "traversal", "robots_file"]
    return _flagged(spark, d).select("seq", "target", "bytes", "top", "ref_path", "ref_host", "host", "site", *[F.col(f).cast("int").alias(f) for f in flags])


def host_site_key(spark, d) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", referer_host(u).alias("host"), site_key(referer_host(u)).alias("site"))


def filter_vhost(spark, d) -> DataFrame:
    e = derived.log(spark, d).withColumn("server_name", F.lit(None).cast("string"))
    return e.where(logs.on_hosts(["EXAMPLE.org"]) & logs.in_window("2024-01-10 00:00:00")).select("seq", "remote_host")


def skip_counters(spark, d) -> DataFrame:
    e = derived.log(spark, d).withColumns({"server_name": F.lit(None).cast("string"), "skip_reason": F.when(F.col("status") == 301, "bad"), "value": F.col("path")})
    return logs.skip_counts(e, "2024-01-10 00:00:00", ["blog"]).drop("first_skipped")


def ua_flags(spark, d) -> DataFrame:
    p = agent_profile(derived.log(spark, d))
    flags = ["ua_empty", "ua_browser", "ua_bot", "ua_library", "ua_feed", "ua_crawler"]
    return p.select("user_agent", *[F.col(f).cast("int").alias(f) for f in flags], "agent_category", "product", "family", "major")


def ua_version_band(spark, d) -> DataFrame:
    p = agent_profile(derived.log(spark, d)).where("major is not null")
    return p.select("user_agent", version_band(F.col("family"), F.col("major"), F.lit("2024-01-31").cast("date")).alias("band"))


def client_volume(spark, d) -> DataFrame:
    f = clients.features(_entries(spark, d))
    counts = ["requests", "total_bytes", "n404", "n304", "distinct_404", "probe_hits", "submit_hits", "traversal_hits", "static_hits", "feed_hits",
              "page_count", "heads", "posts", "distinct_paths", "distinct_targets", "referers", "self_referers", "peak_rpm"]
    return f.select(*KEY, *counts, _r("ratio_2xx").alias("ratio_2xx"), _r("ratio_404").alias("ratio_404"), _r("mean_bytes").alias("mean_bytes"), _r("duration", 3).alias("duration"))


def iat_stats(spark, d) -> DataFrame:
    f = clients.features(_entries(spark, d))
    return f.select(*KEY, "iat_n", *[_r(c, 4).alias(c) for c in ("iat_mean", "iat_median", "iat_p95", "iat_min", "regularity")])


def breadth(spark, d) -> DataFrame:
    return clients.features(_entries(spark, d)).select(*KEY, "turns", _r("breadth").alias("breadth"))


def referer_following(spark, d) -> DataFrame:
    return clients.features(_entries(spark, d)).select(*KEY, "followed", _r("follow_ratio").alias("follow_ratio"))


def coload(spark, d) -> DataFrame:
    return clients.coload(_entries(spark, d)).select(*KEY, "pages_total", F.col("pages_satisfied").cast("bigint").alias("pages_satisfied"))


def request_buckets(spark, d) -> DataFrame:
    return clients.request_buckets(_flagged(spark, d))


def ua_count_for_ip(spark, d) -> DataFrame:
    return clients.ua_count(derived.log(spark, d))


def _ranges(spark):
    r = spark.createDataFrame(CIDRS, "rank int, name string, cidr string")
    lo, hi = network.cidr_bounds(F.col("cidr"))
    return r.select("rank", "name", lo.alias("lo"), hi.alias("hi"))


def range_attribution(spark, d) -> DataFrame:
    return network.in_ranges(derived.log(spark, d), _ranges(spark))


def route_fold(spark, d) -> DataFrame:
    r = _ranges(spark)
    e = census.attributed(derived.log(spark, d), r.where("name = 'beta'"), r.where("name = 'gamma'"))
    return e.groupBy("route", *KEY).agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("remote_host").alias("members"))


def identity_subnet(spark, d) -> DataFrame:
    e = clients.with_client(derived.log(spark, d), "ip_ua_subnet")
    return e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("requests"))


def redirect_shadow(spark, d) -> DataFrame:
    return network.redirect_sides(_flagged(spark, d)).drop("first")


def robots_verdict(spark, d) -> DataFrame:
    e = _flagged(spark, d)
    p = agent_profile(e).select(F.col("user_agent").alias("_u"), "product")
    e = e.join(p, F.col("user_agent").eqNullSafe(F.col("_u")), "left").drop("_u")
    return robots.compliance(e, robots.parse(ROBOTS), KEY)


def nonce_replay(spark, d) -> DataFrame:
    e = derived.log(spark, d).withColumn("nonce", F.when(F.col("status") == 200, F.col("bytes_sent") % 997))
    return network.nonce_use(e).withColumns({"replayed": F.col("replayed").cast("int"), "reused": F.col("reused").cast("int")})


def _classified(spark, d):
    return census.classified(_entries(spark, d))


def client_scores(spark, d) -> DataFrame:
    return _classified(spark, d).select(*KEY, *[F.col(f"s_{k}") for k in classify.SCORES])


def client_kinds(spark, d) -> DataFrame:
    return _classified(spark, d).select(*KEY, "kind", "confidence")


def tags_long(spark, d) -> DataFrame:
    return _classified(spark, d).select(*KEY, F.explode("tags").alias("tag"))


def kind_rollup(spark, d) -> DataFrame:
    e = _flagged(spark, d)
    p = agent_profile(e).select(F.col("user_agent").alias("_u"), "product")
    v = robots.compliance(e.join(p, F.col("user_agent").eqNullSafe(F.col("_u")), "left").drop("_u"), robots.parse(ROBOTS), KEY)
    v = v.select(F.col("client_ip").alias("_i"), F.col("client_ua").alias("_a"), "verdict")
    c = census.classified(_entries(spark, d)).join(v, F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_a")), "left").drop("_i", "_a")
    return rollup.kind_rollup(c)


def network_kind_rollup(spark, d) -> DataFrame:
    e = census.attributed(derived.log(spark, d), _ranges(spark), None)
    return rollup.network_rollup(census.classified(e)).withColumn("all_networks", F.col("all_networks").cast("int"))


def network_matrix(spark, d) -> DataFrame:
    e = census.attributed(derived.log(spark, d), _ranges(spark), None)
    return rollup.matrix(rollup.kind_rollup(census.classified(e), "network", "egress"), 2)


def cadence_grid(spark, d) -> DataFrame:
    return rollup.cadence(derived.log(spark, d).withColumn("kind", F.coalesce("method", F.lit("none"))))


def relative_thresholds(spark, d) -> DataFrame:
    out = rollup.thresholds(_classified(spark, d))
    return out.select("pool", *[_r(c).alias(c) for c in out.columns if c != "pool"])


def relative_tags(spark, d) -> DataFrame:
    c = _classified(spark, d)
    return rollup.outlier_tags(c, rollup.thresholds(c)).select(*KEY, F.array_join("tags", ",").alias("tags"))


def topk_per_kind(spark, d) -> DataFrame:
    """The feature is the limit: the three busiest clients of each kind."""
    return rollup.top_clients(_classified(spark, d), 3).select("kind", *KEY, "requests")


def actor_groups(spark, d) -> DataFrame:
    return rollup.actors(_classified(spark, d))


def score_conflicts(spark, d) -> DataFrame:
    return rollup.conflicts(_classified(spark, d)).select(*KEY, "kind", "claims")


def _any(expr: str, words: list[str]) -> str:
    tests = " OR ".join(f"contains({expr}, '{w.lower()}')" for w in words)
    return f"coalesce({tests}, FALSE)"


# Reference SQL. Flags of an entry, and clients, as common table expressions.
_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.([^.]*)$', 1))"
_STATIC = f"({_EXT} IN ({', '.join(repr(x) for x in C.STATIC_EXT)}))"
_REF_HOST = r"regexp_extract(referer, '^https?://([^/?#]*)', 1)"
FLAGS = f"""
log AS ({derived.SQL}),
f AS (
  SELECT *, remote_host AS client_ip, user_agent AS client_ua,
    CASE WHEN query <> '' THEN path || '?' || query ELSE path END AS target, bytes_sent AS bytes,
    {_STATIC} AS static,
    (status = 200 AND NOT {_STATIC} AND (ends_with(path, '/') OR {_EXT} = '' OR {_EXT} IN ({', '.join(repr(x) for x in C.PAGE_EXT)}))) AS page,
    (regexp_extract(path, '[^/]*$') = 'index.xml' OR len(list_intersect(regexp_split_to_array(lower(regexp_extract(path, '[^/]*$')), '[._-]'), ['feed','rss','atom'])) > 0) AS feed,
    ({_any('lower(path)', C.ALWAYS_PROBE)} OR ({_any('lower(path)', C.PROBE_IF_ABSENT)} AND status IN (404, 410))) AS probe,
    (method = 'POST' AND {_any('lower(path)', C.SUBMIT)}) AS submit,
    {_any("lower(path) || lower(coalesce(query, ''))", [w for w in C.TRAVERSAL])} AS traversal,
    path = '/robots.txt' AS robots_file, {_any("lower(path) || lower(coalesce(query, ''))", C.EVASION)} AS evasion, coalesce(method IN ('PUT', 'DELETE'), FALSE) AS exotic,
    regexp_extract(path, '^/*([^/]+)', 1) AS top,
    CASE WHEN referer <> '' THEN regexp_replace(split_part(referer, '?', 1), '^[^/]*://[^/]*', '') END AS ref_path,
    CASE WHEN referer <> '' THEN {_REF_HOST} END AS ref_host,
    lower(split_part(host_header, ':', 1)) AS host,
    regexp_replace(lower(split_part(host_header, ':', 1)), '^www\\.', '') AS site
  FROM log)"""
_INT = ["static", "page", "feed", "probe", "submit", "traversal", "robots_file"]
_BEFORE = "OVER (PARTITION BY client_ip, client_ua ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORDERED = f"""
o AS (
  SELECT *, lag(top) OVER (PARTITION BY client_ip, client_ua ORDER BY seq) <> top AS turned,
    max(CASE WHEN NOT static THEN ts END) {_BEFORE} AS newest,
    min(seq) OVER (PARTITION BY client_ip, client_ua, path) AS own_first
  FROM f),
firsts AS (SELECT client_ip AS i, client_ua AS u, path AS p, min(seq) AS first_seq FROM f GROUP BY ALL),
g AS (
  SELECT o.*, CASE WHEN NOT static AND ts >= newest THEN (epoch_us(ts) - epoch_us(newest)) / 1e6 END AS delta,
    (referer <> '' AND ref_path = path) AS self_ref, (referer <> '' AND ref_path <> path AND first_seq < seq) AS followed_
  FROM o LEFT JOIN firsts ON client_ip = i AND client_ua = u AND ref_path = p)"""
UA = f"""
ua AS (
  SELECT *, trim(coalesce(user_agent, '')) = '' AS ua_empty,
    {_any('lower(user_agent)', C.AUTOMATION)} OR regexp_matches(lower(user_agent), '\\b(feed|rss)\\b|bot\\b|\\+(https?://|www\\.|mailto:)') AS ua_bot0,
    regexp_matches(lower(user_agent), 'mozilla/[0-9].*({'|'.join(C.ENGINES)})') AS shape,
    {_any('lower(user_agent)', C.LIBRARIES)} AS ua_library,
    regexp_matches(lower(user_agent), '\\b(feed|rss|atom|podcast|subscriber)\\b') OR {_any('lower(user_agent)', C.FEED_READERS)} AS ua_feed0
  FROM (SELECT DISTINCT user_agent FROM log)),
u AS (
  SELECT user_agent, ua_empty::INT AS ua_empty, (shape AND NOT ua_bot0)::INT AS ua_browser, ua_bot0::INT AS ua_bot, ua_library::INT AS ua_library,
    ua_feed0::INT AS ua_feed, (CASE WHEN contains(user_agent, 'Googlebot') OR contains(user_agent, 'GPTBot') THEN 1 ELSE 0 END) AS ua_crawler,
    CASE WHEN contains(user_agent, 'Googlebot') THEN 'search_engine' WHEN contains(user_agent, 'GPTBot') THEN 'ai_crawler' END AS agent_category
  FROM ua)"""
_N = "count(*)"
FEATURES = f"""
m AS (SELECT client_ip AS mi, client_ua AS mu, max(n) AS peak_rpm FROM (
  SELECT client_ip, client_ua, (epoch_us(ts) // 60000000) AS mm, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL),
c AS (
  SELECT client_ip, client_ua, count(*) AS requests, sum(bytes)::BIGINT AS total_bytes, count_if(status = 404) AS n404, count_if(status = 304) AS n304,
    count_if(status = 403) AS n403,
    least(count(DISTINCT CASE WHEN status = 404 THEN target END), 256) AS distinct_404, count_if(probe) AS probe_hits, count_if(submit) AS submit_hits,
    count_if(traversal) AS traversal_hits, count_if(evasion) AS evasion_hits, count_if(exotic) AS exotic_hits, min(ts) AS first_seen, max(ts) AS last_seen, count_if(static) AS static_hits, count_if(feed) AS feed_hits, count_if(page) AS page_count,
    count_if(method = 'HEAD') AS heads, count_if(method = 'POST') AS posts, count(DISTINCT path) AS distinct_paths,
    least(count(DISTINCT target), 256) AS distinct_targets, count_if(referer <> '') AS referers, count_if(self_ref) AS self_referers,
    count_if(turned) AS turns, count_if(followed_) AS followed, count_if(status BETWEEN 200 AND 299) / count(*) AS ratio_2xx, bool_or(robots_file) AS fetched,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration, list_sort(list(delta) FILTER (delta IS NOT NULL)) AS deltas, count(delta) AS iat_n,
    avg(delta) AS iat_mean, min(delta) AS iat_min, stddev_pop(delta) / nullif(avg(delta), 0) AS regularity
  FROM g GROUP BY ALL),
q AS (
  SELECT c.*, m.peak_rpm, CASE WHEN iat_n > 256 THEN NULL WHEN iat_n % 2 = 1 THEN deltas[(iat_n // 2 + 1)] ELSE (deltas[(iat_n // 2)] + deltas[(iat_n // 2 + 1)]) / 2 END AS med,
    deltas[(round_even(0.95 * (iat_n - 1), 0)::INT + 1)] AS p95
  FROM c JOIN m ON client_ip = mi AND client_ua = mu)"""
def _binned(q: str) -> str:
    v = f"deltas[greatest(ceil({q} * iat_n), 1)::INT]"
    return f"CASE WHEN {v} <= 0 THEN 0.0 ELSE pow(10.0, (least(greatest(floor((log10({v}) + 3) * 10) + 1, 1), 101) - 0.5) / 10 - 3) END"


_HEX = "lpad(to_hex(65535::BIGINT) || lpad(lower(to_hex(n)), 8, '0'), 32, '0')"
_IPN = " + ".join(f"TRY_CAST(split_part(remote_host, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
_NET = "CASE WHEN contains(remote_host, ':') THEN regexp_replace(remote_host, ':1::[0-9]+$', '::/48') ELSE regexp_replace(remote_host, '[^.]*$', '0/24') END"
_RANGE_ROWS = ", ".join(
    f"({r}, '{n}', {sum(int(x) * 256 ** (3 - i) for i, x in enumerate(c.split('/')[0].split('.')))}, {2 ** (32 - int(c.split('/')[1]))})" for r, n, c in CIDRS
)
_RANGED = f"""log AS ({derived.SQL}), ip AS (SELECT DISTINCT remote_host, {_IPN} AS n FROM log),
r(rank, name, lo, size) AS (VALUES {_RANGE_ROWS}),
hits AS (SELECT remote_host AS ip, min(struct_pack(rank := rank, name := name)) AS b FROM ip JOIN r ON n >= lo AND n < lo + size GROUP BY 1)"""


def reference() -> dict[str, str]:
    key = "client_ip, client_ua"
    return {
        "entry_flags": f"WITH {FLAGS} SELECT seq, target, bytes, top, ref_path, ref_host, host, site, {', '.join(f'coalesce({x}, FALSE)::INT AS {x}' for x in _INT)} FROM f",
        "host_site_key": r"WITH h AS (SELECT page_id, nullif(lower(regexp_replace(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#]*)', 1), ':[0-9]+$', '')), '') AS host FROM pages) SELECT page_id, host, regexp_replace(host, '^www\.', '') AS site FROM h",
        "filter_vhost": f"WITH log AS ({derived.SQL}) SELECT seq, remote_host FROM log WHERE contains(lower(host_header), 'example.org') AND ts >= TIMESTAMP '2024-01-10'",
        "skip_counters": f"WITH log AS ({derived.SQL}) SELECT count(*) AS total, count_if(status <> 301) AS parsed, count_if(status = 301) AS skipped, count_if(status <> 301 AND ts < TIMESTAMP '2024-01-10') AS out_of_window, count_if(status <> 301 AND ts >= TIMESTAMP '2024-01-10' AND NOT contains(host_header, 'blog')) AS excluded, count_if(status <> 301 AND ts IS NULL) AS untimed FROM log",
        "ua_flags": f"""WITH log AS ({derived.SQL}), {UA} SELECT u.*, CASE WHEN contains(user_agent, 'Googlebot') THEN 'googlebot' WHEN contains(user_agent, 'Mozilla') OR user_agent = '' THEN NULL ELSE lower(split_part(user_agent, '/', 1)) END AS product,
            CASE WHEN contains(user_agent, 'Firefox/') THEN 'firefox' WHEN contains(user_agent, 'Chrome/') THEN 'chrome' WHEN contains(user_agent, 'Version/') THEN 'safari' END AS family,
            nullif(regexp_extract(user_agent, '(?:Firefox|Chrome|Version)/([0-9]+)', 1), '')::BIGINT AS major FROM u""",
        "client_volume": f"WITH {FLAGS}, {ORDERED}, {FEATURES} SELECT {key}, requests, total_bytes, n404, n304, distinct_404, probe_hits, submit_hits, traversal_hits, static_hits, feed_hits, page_count, heads, posts, distinct_paths, distinct_targets, referers, self_referers, peak_rpm, round(ratio_2xx, 6) AS ratio_2xx, round(n404 / requests, 6) AS ratio_404, round(total_bytes / requests, 6) AS mean_bytes, round(duration, 3) AS duration FROM q",
        "iat_stats": f"WITH {FLAGS}, {ORDERED}, {FEATURES} SELECT {key}, iat_n, round(iat_mean, 4) AS iat_mean, round(CASE WHEN iat_n <= 256 THEN med ELSE {_binned('0.5')} END, 4) AS iat_median, round(CASE WHEN iat_n <= 256 THEN p95 ELSE {_binned('0.95')} END, 4) AS iat_p95, round(iat_min, 4) AS iat_min, round(regularity, 4) AS regularity FROM q",
        "breadth": f"WITH {FLAGS}, {ORDERED}, {FEATURES} SELECT {key}, turns, round(CASE WHEN requests > 1 THEN turns / (requests - 1) ELSE 0 END, 6) AS breadth FROM q",
        "referer_following": f"WITH {FLAGS}, {ORDERED}, {FEATURES} SELECT {key}, followed, round(followed / requests, 6) AS follow_ratio FROM q",
        "request_buckets": f"WITH {FLAGS}, t AS (SELECT {key}, ((epoch_us(ts) // 60000000))::BIGINT AS m FROM f), w AS (SELECT *, min(m) OVER (PARTITION BY {key}) AS lo, max(m) OVER (PARTITION BY {key}) AS hi FROM t) SELECT {key}, least(((m - lo) * 40) // (hi - lo), 39)::INT AS bucket, count(*) AS requests FROM w WHERE hi > lo GROUP BY ALL",
        "ua_count_for_ip": f"WITH log AS ({derived.SQL}) SELECT remote_host AS ip, count(DISTINCT user_agent) + max((user_agent IS NULL)::INT) AS uas FROM log GROUP BY 1",
        "client_scores": f"""WITH {FLAGS}, {ORDERED}, {FEATURES}, {UA}, s AS (
            SELECT client_ip, client_ua, agent_category, ua_feed, requests AS n, 0.7 + 0.08 * fetched::INT + 0.05 * (probe_hits = 0 AND traversal_hits = 0 AND evasion_hits = 0)::INT AS known,
              0.45 * (probe_hits >= 3 OR probe_hits / requests >= 0.5)::INT + 0.2 * (probe_hits BETWEEN 1 AND 2 AND probe_hits / requests < 0.5)::INT
              + 0.3 * (n404 / requests > 0.6 AND distinct_404 >= 15)::INT + 0.3 * (n403 >= 5 AND n403 / requests >= 0.5)::INT + 0.15 * (traversal_hits > 0)::INT + 0.25 * (evasion_hits > 0)::INT AS scan,
              0.1 * coalesce(med < 0.5 AND requests >= 5, FALSE)::INT AS quick, feed_hits / requests >= 0.5 AS much,
              0.2 * (feed_hits > 0 AND feed_hits / requests < 0.5)::INT + 0.5 * (feed_hits / requests >= 0.5)::INT + 0.5 * ua_feed
              + 0.1 * (distinct_targets <= 3 AND requests >= 4)::INT + 0.1 * coalesce(regularity < 0.3 AND requests >= 4, FALSE)::INT + 0.1 * (n304 > 0)::INT
              + 0.1 * (heads / requests > 0.2)::INT AS feeds,
              0.2 * (distinct_targets <= 2 AND requests >= 5)::INT + 0.2 * (heads / requests > 0.5)::INT + 0.25 * coalesce(regularity < 0.2 AND requests >= 5, FALSE)::INT AS watch
            FROM q JOIN u ON client_ua = u.user_agent)
            SELECT client_ip, client_ua, round(CASE WHEN agent_category = 'search_engine' THEN known END, 3)::DOUBLE AS s_search_engine,
              round(CASE WHEN agent_category = 'ai_crawler' THEN known END, 3)::DOUBLE AS s_ai_crawler,
              round(CASE WHEN scan > 0 THEN least(scan + quick, 1) END, 3)::DOUBLE AS s_vuln_scanner,
              round(CASE WHEN ua_feed = 1 OR much THEN least(feeds, 1) END, 3)::DOUBLE AS s_feed_reader,
              round(CASE WHEN watch > 0 THEN watch END, 3)::DOUBLE AS s_monitor FROM s""",
        "ua_version_band": f"""WITH log AS ({derived.SQL}), v AS (SELECT DISTINCT user_agent, regexp_extract(user_agent, '(Firefox|Chrome|Version)/', 1) AS fam, nullif(regexp_extract(user_agent, '(?:Firefox|Chrome|Version)/([0-9]+)', 1), '')::BIGINT AS m FROM log),
            a AS (SELECT *, date_diff('day', CASE fam WHEN 'Chrome' THEN DATE '2023-12-06' + ((m - 120) * 30)::INT WHEN 'Firefox' THEN DATE '2023-12-19' + ((m - 121) * 30)::INT ELSE DATE '2023-09-18' + ((m - 17) * 365)::INT END, DATE '2024-01-31') / 30.4 AS age FROM v WHERE m IS NOT NULL)
            SELECT user_agent, CASE WHEN fam = 'Version' THEN CASE WHEN age < -13 THEN NULL WHEN age <= 13 THEN 'current' WHEN age >= 24 THEN 'stale' END WHEN age < -12 THEN 'impossible' WHEN age <= 6 THEN 'current' WHEN age >= 36 THEN 'ancient' WHEN age >= 18 THEN 'stale' END AS band FROM a""",
        "range_attribution": f"WITH {_RANGED} SELECT ip, b.rank AS rank, b.name AS name FROM hits",
        "identity_subnet": f"WITH log AS ({derived.SQL}) SELECT CASE WHEN contains(remote_host, ':') THEN regexp_replace(remote_host, '::[0-9]+$', '::/64') ELSE regexp_replace(remote_host, '[^.]*$', '0/24') END AS client_ip, user_agent AS client_ua, count(*) AS requests FROM log GROUP BY ALL",
        "redirect_shadow": f"WITH {FLAGS} SELECT site, count(*) AS requests, count_if(starts_with(host, 'www.')) AS www, count_if(starts_with(host, 'www.') AND status BETWEEN 300 AND 399) AS www_3xx, count_if(NOT starts_with(host, 'www.')) AS bare, count_if(NOT starts_with(host, 'www.') AND status BETWEEN 300 AND 399) AS bare_3xx FROM f GROUP BY 1",
        "robots_verdict": f"WITH {FLAGS}, b AS (SELECT *, CASE WHEN robots_file THEN FALSE WHEN contains(user_agent, 'GPTBot') THEN TRUE ELSE starts_with(path, '/shop/') AND NOT starts_with(path, '/shop/item1') END AS bad FROM f) SELECT {key}, count_if(bad) AS disallowed_hits, CASE WHEN count_if(bad) > 0 THEN 'ignores' WHEN bool_or(robots_file) OR count(*) >= 5 THEN 'respects' ELSE 'unknown' END AS verdict FROM b GROUP BY ALL",
        "nonce_replay": f"WITH log AS ({derived.SQL}), n AS (SELECT bytes_sent % 997 AS nonce, remote_host, seq FROM log WHERE status = 200) SELECT nonce, count(*) AS uses, arg_min(remote_host, seq) AS first_ip, (count(DISTINCT remote_host) > 1)::INT AS replayed, (count(*) > 1 AND count(DISTINCT remote_host) = 1)::INT AS reused FROM n GROUP BY 1",
        "cadence_grid": f"WITH log AS ({derived.SQL}) SELECT method AS kind, ((epoch_us(ts) // 300000000) * 300)::BIGINT AS slot, count(*) AS requests FROM log GROUP BY ALL",
        "route_fold": f"""WITH {_RANGED}, x AS (SELECT log.*, ({_IPN}) AS n FROM log),
            k AS (SELECT *, CASE WHEN n >= {10 * 2**24 + 2**16} AND n < {10 * 2**24 + 2 * 2**16} THEN 'egress' WHEN contains(user_agent, 'Googlebot') OR contains(user_agent, 'GPTBot') THEN 'declared' WHEN n >= {10 * 2**24 + 16 * 256} AND n < {10 * 2**24 + 32 * 256} THEN 'hosting' ELSE 'regular' END AS route FROM x)
            SELECT route, CASE route WHEN 'egress' THEN 'gamma' WHEN 'regular' THEN remote_host ELSE {_NET} END AS client_ip,
            CASE route WHEN 'declared' THEN CASE WHEN contains(user_agent, 'Googlebot') THEN 'googlebot' ELSE 'gptbot' END ELSE user_agent END AS client_ua, count(*) AS requests, count(DISTINCT remote_host) AS members FROM k GROUP BY ALL""",
    }


def routed_log() -> str:
    """The log with client, hosting and route of each entry, as a CTE list."""
    return f"""log0 AS ({derived.SQL}), ip AS (SELECT DISTINCT remote_host, {_IPN} AS n FROM log0),
r(rank, name, lo, size) AS (VALUES {_RANGE_ROWS}),
hits AS (SELECT remote_host AS hip, min(struct_pack(rank := rank, name := name)) AS b FROM ip JOIN r ON n >= lo AND n < lo + size GROUP BY 1),
log1 AS (SELECT log0.*, b.name AS hosting, CASE WHEN contains(user_agent, 'Googlebot') OR contains(user_agent, 'GPTBot') THEN 'declared' WHEN b IS NOT NULL THEN 'hosting' ELSE 'regular' END AS route
  FROM log0 LEFT JOIN hits ON remote_host = hip),
log AS (SELECT *, CASE WHEN route = 'regular' THEN remote_host ELSE {_NET} END AS client_ip,
  CASE WHEN route = 'declared' THEN CASE WHEN contains(user_agent, 'Googlebot') THEN 'googlebot' ELSE 'gptbot' END ELSE user_agent END AS client_ua FROM log1)"""


# Co-load by the letter: client by client, one event after another.
COLOAD = """
ev AS (SELECT client_ip, client_ua, row_number() OVER (PARTITION BY client_ip, client_ua ORDER BY seq) AS i, epoch_us(ts) / 1e6 AS t,
    CASE WHEN page THEN 'P' WHEN static AND NOT (contains(lower(path), 'favicon') OR contains(lower(path), 'apple-touch-icon')) AND referer <> '' THEN 'A' ELSE 'O' END AS k,
    CASE WHEN page THEN path ELSE ref_path END AS p FROM f WHERE ts IS NOT NULL),
fold AS (
  SELECT client_ip, client_ua, 0::BIGINT AS i, []::STRUCT(t DOUBLE, p VARCHAR)[] AS pend, 0::BIGINT AS hits FROM (SELECT DISTINCT client_ip, client_ua FROM ev)
  UNION ALL
  SELECT client_ip, client_ua, i, CASE WHEN k = 'P' THEN list_append(kept, {'t': t, 'p': p}) WHEN k = 'A' AND spot > 0 THEN list_concat(kept[:spot - 1], kept[spot + 1:]) ELSE kept END,
    hits + (k = 'A' AND spot > 0)::INT
  FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda y: y.p), p), 0) AS spot FROM (
    SELECT ev.*, fold.hits, CASE WHEN list_position(list_transform(fold.pend, lambda y: y.t >= ev.t - 10), TRUE) > 0
      THEN fold.pend[list_position(list_transform(fold.pend, lambda y: y.t >= ev.t - 10), TRUE):] ELSE [] END AS kept
    FROM fold JOIN ev ON fold.client_ip = ev.client_ip AND fold.client_ua IS NOT DISTINCT FROM ev.client_ua AND ev.i = fold.i + 1))),
cl AS (SELECT ev.client_ip AS li, ev.client_ua AS lu, count_if(k = 'P') AS pages_total, any_value(h) AS pages_satisfied
  FROM ev JOIN (SELECT client_ip, client_ua, max(hits) AS h FROM fold GROUP BY ALL) z ON ev.client_ip = z.client_ip AND ev.client_ua IS NOT DISTINCT FROM z.client_ua GROUP BY ALL)"""


def _b(c: str) -> str:
    return f"coalesce({c}, FALSE)"


def _add(*parts) -> str:
    return " + ".join(f"CASE WHEN {_b(c)} THEN {w} ELSE 0 END" for c, w in parts)


def scored(routed: bool = False) -> str:
    """CTEs up to ``k``: a row per client with scores, kind, confidence and tags."""
    flags = FLAGS
    if routed:
        flags = FLAGS.replace(f"log AS ({derived.SQL})", routed_log()).replace("remote_host AS client_ip, user_agent AS client_ua,", "")
    hosting = "min(hosting)" if routed else "NULL::VARCHAR"
    strong, wide = "(probe_hits >= 3 OR probe_hits / n >= 0.5)", "(distinct_paths >= 10 AND n >= 15)"
    known, recognised = "(ua_bot OR ua_crawler OR ua_feed)", "(ua_crawler OR ua_feed)"
    probing, forged = "(traversal_hits > 0 OR evasion_hits > 0 OR probe_hits >= 2)", "(selfr >= 0.5 AND n >= 4)"
    old = "coalesce(band IN ('ancient', 'impossible'), FALSE)"
    first = [("page_count >= 1 AND cold > 0.4", 0.45), ("ua_browser", 0.2), ("reg > 0.6", 0.1), ("reg < 0.15 AND n >= 5", -0.2), ("follow > 0.3", 0.1), ("n404 / n < 0.1 AND probe_hits = 0", 0.1),
             ("static_hits / n > 0.3", 0.05), ("n304 > 0", 0.1)]
    said = "(" + " OR ".join(_b(c) for c, _ in first) + ")"
    steps = [(f"{said} AND {old}", None), (f"{said} AND band = 'current'", 0.1), (f"{said} AND band = 'stale'", -0.15), (f"{said} AND fetched", -0.15), (f"{said} AND hnc AND refetch", None),
             (f"{said} AND hnc AND NOT refetch", -0.2), (probing, None), (forged, None), (f"({said} OR {probing} OR {forged}) AND heads / n > 0.1", None)]
    chain, expr = [], f"({_add(*first)})"
    for j, (cond, credit) in enumerate(steps):
        chain.append(f"{expr} AS b{j}")
        expr = f"CASE WHEN {_b(cond)} THEN least(b{j}, 0.3) ELSE b{j} END" if credit is None else f"b{j} + CASE WHEN {_b(cond)} THEN {credit} ELSE 0 END"
    chain.append(f"{expr} AS b9")
    out = f"({_b('reg < 0.15 AND n >= 5')} OR {old} OR fetched OR hnc OR {probing} OR {forged} OR heads / n > 0.1)"
    lean = "(cold < 0.1 AND n >= 4)"
    score = {
        **{k: f"CASE WHEN agent_category = '{k}' THEN 0.7 + {_add(('fetched', 0.08), ('clean', 0.05))} END" for k in C.KINDS[1:10]},
        "vuln_scanner": f"CASE WHEN scan > 0 THEN scan + {_add(('med < 0.5 AND n >= 5', 0.1))} END",
        "spam_bot": f"nullif({_add(('posts / n > 0.3 AND posts >= 3', 0.4), ('posts / n > 0.3 AND cold < 0.1', 0.15), ('submit_hits > 0', 0.15))}, 0)",
        "feed_reader": f"CASE WHEN ua_feed OR feedr >= 0.5 THEN {_add(('feedr >= 0.5', 0.5), ('feedr < 0.5 AND feed_hits > 0', 0.2), ('ua_feed', 0.5), ('distinct_targets <= 3 AND n >= 4', 0.1), ('reg < 0.3 AND n >= 4', 0.1), ('n304 > 0', 0.1), ('heads / n > 0.2', 0.1))} END",
        "monitor": f"nullif({_add(('ua_monitor', 0.4), ('distinct_targets <= 2 AND n >= 5', 0.2), ('heads / n > 0.5', 0.2), ('reg < 0.2 AND n >= 5', 0.25))}, 0)",
        "browser": f"CASE WHEN ({said} OR {probing} OR {forged}) AND NOT {known} THEN greatest(b9, CASE WHEN ua_browser AND NOT {out} THEN 0.45 ELSE -9 END) END",
        "app": f"CASE WHEN ua_app AND NOT {known} THEN 0.65 END",
        "scraper": f"CASE WHEN scrape > 0 AND NOT {recognised} THEN scrape + {_add(('probe_hits = 0 AND ratio_2xx > 0.6', 0.05))} END",
        "crawler": f"CASE WHEN crawl > 0 AND NOT {recognised} THEN crawl + {_add(('ratio_2xx > 0.7 AND cold < 0.1', 0.1))} END",
        "spoofed_browser": f"CASE WHEN ua_browser AND NOT {known} AND feedr < 0.5 AND n >= 2 AND round(spoof, 3) >= 0.45 THEN least(spoof, 0.9) END",
    }
    scan = _add(("ua_scanner", 0.5), (strong, 0.45), (f"NOT {strong} AND probe_hits > 0", 0.2), ("n404 / n > 0.6 AND distinct_404 >= 15", 0.3), ("n403 >= 5 AND n403 / n >= 0.5", 0.3), ("traversal_hits > 0", 0.15), ("evasion_hits > 0", 0.25), ("exotic_hits > 0", 0.1))
    scrape = _add((f"{wide} AND cold < 0.1 AND NOT ua_browser", 0.3), (f"{wide} AND follow < 0.1", 0.15), ("ua_library", 0.2), (f"NOT ua_library AND ua_empty AND {wide}", 0.15))
    crawl = _add(("distinct_paths >= 20 AND distinct_paths / n > 0.7", 0.3), ("reg < 0.5 AND n >= 10", 0.2), ("follow > 0.3", 0.15), ("ua_bot", 0.15), (f"ua_bot AND {lean} AND distinct_paths >= 20", 0.3), (f"ua_bot AND {lean} AND distinct_paths < 20", 0.2))
    spoof = _add(("dc", 0.3), ("heads / n > 0.1", 0.3), (forged, 0.3), ("hnc AND refetch", 0.45), ("cold < 0.4 AND page_count > 0 AND cold = 0", 0.15), ("cold < 0.4 AND follow = 0", 0.15), ("cold < 0.4 AND n >= 10 AND 1 - referers / n >= 0.9", 0.2), (f"cold < 0.4 AND {old}", 0.15))
    best = ", ".join(f"{{'c': s_{k}, 'r': {-C.KINDS.index(k)}, 'k': '{k}'}}" for k in score)
    generic, bot = "(band IS NULL AND NOT ua_browser AND ua_library)", f"(band IS NULL AND NOT ua_browser AND NOT ua_library AND ua_bot AND NOT {recognised})"
    tell, dcs = f"((n304 = 0 AND hnc) OR {generic} OR {bot})", "(dc AND n >= 5 AND distinct_paths >= 3 AND (ua_library OR ua_empty) AND clean)"
    fake = f"(ua_browser AND NOT {known} AND n >= 2 AND cold = 0 AND follow = 0)"
    tags = {
        "metronomic": "n >= 5 AND reg < 0.15", "steady": "n >= 5 AND reg BETWEEN 0.15 AND 0.6", "bursty": "n >= 5 AND reg > 0.6", "loads-assets": "page_count >= 1 AND cold > 0.4", "no-assets": "page_count >= 1 AND cold < 0.1",
        "follows-links": "referers > 0 AND n >= 4 AND follow > 0.3", "cold": "referers > 0 AND n >= 4 AND follow < 0.1", "has-cache": "n304 > 0", "lacks-cache": "n304 = 0 AND hnc",
        **{f"{x}-browser-ua": f"band = '{x}'" for x in ("current", "stale", "ancient", "impossible")}, "browser-ua": "band IS NULL AND ua_browser", "generic-ua": generic, "bot-ua": bot,
        "probe-paths": "probe_hits >= 3 OR probe_hits / n >= 0.05", "traversal": "traversal_hits > 0", "encoding-evasion": "evasion_hits > 0", "404-storm": "n404 / n > 0.6 AND distinct_404 >= 15",
        "often-forbidden": "n403 >= 5 AND n403 / n >= 0.5", "exotic-method": "exotic_hits > 0", "uses-HEAD": "heads / n > 0.1", "post-heavy": "posts / n > 0.5 AND n >= 5",
        "forged-referer": f"{forged} AND ua_browser AND NOT {known}", "singleton": "n = 1", "datacenter": "dc", "no-user-agent": "ua_empty", "checked-robots": "fetched", "declares-known-bot": "ua_crawler",
        "fetches-feeds": "ua_feed", "polls-feeds": "feed_hits > 0", "ua-rotating": f"uas >= 4 AND (dc OR {fake})", "shared-ip": f"uas >= 4 AND NOT (dc OR {fake})",
        "fetches-non-feeds": "kind = 'feed_reader' AND n - feed_hits - fetched::INT > 0",
    }
    listed = ", ".join(f"CASE WHEN {_b(c)} THEN '{t}' END" for t, c in tags.items())
    band = "CASE WHEN fam = 'Version' THEN CASE WHEN age < -13 THEN NULL WHEN age <= 13 THEN 'current' WHEN age >= 24 THEN 'stale' END WHEN age < -12 THEN 'impossible' WHEN age <= 6 THEN 'current' WHEN age >= 36 THEN 'ancient' WHEN age >= 18 THEN 'stale' END"
    age = "date_diff('day', CASE fam WHEN 'Chrome' THEN DATE '2023-12-06' + ((ver - 120) * 30)::INT WHEN 'Firefox' THEN DATE '2023-12-19' + ((ver - 121) * 30)::INT WHEN 'Version' THEN DATE '2023-09-18' + ((ver - 17) * 365)::INT END, last_seen::DATE) / 30.4"
    flag = lambda x: f"coalesce(u.{x}, 0) = 1 AS {x}"
    words = lambda w: _any("lower(said)", w)
    regular = "WHERE route = 'regular'" if routed else ""
    return f"""WITH RECURSIVE {flags}, {ORDERED}, {FEATURES}, {UA}, {COLOAD},
said AS (SELECT client_ip AS si, client_ua AS su, arg_min(user_agent, seq) FILTER (user_agent <> '') AS said, {hosting} AS network FROM f GROUP BY ALL),
cnt AS (SELECT remote_host AS ci, count(DISTINCT user_agent) + max((user_agent IS NULL)::INT) AS uas FROM log {regular} GROUP BY 1),
x0 AS (
  SELECT q.*, said, network, requests AS n, network IS NOT NULL AS dc, {", ".join(flag(c) for c in ("ua_browser", "ua_bot", "ua_library", "ua_feed", "ua_crawler"))}, said IS NULL AS ua_empty,
    u.agent_category, {words(C.SCANNERS)} AS ua_scanner, {words(C.MONITORS)} AS ua_monitor, {words(C.APPS)} AS ua_app, uas,
    coalesce(pages_satisfied / nullif(pages_total, 0), 0) AS cold, followed / requests AS follow, self_referers / requests AS selfr, feed_hits / requests AS feedr, regularity AS reg,
    CASE WHEN iat_n <= 256 THEN med ELSE {_binned('0.5')} END AS med_, requests - distinct_paths AS again, probe_hits = 0 AND traversal_hits = 0 AND evasion_hits = 0 AS clean,
    regexp_extract(said, '(Firefox|Chrome|Version)/', 1) AS fam, nullif(regexp_extract(said, '(?:Firefox|Chrome|Version)/([0-9]+)', 1), '')::BIGINT AS ver
  FROM q JOIN said ON client_ip = si AND client_ua IS NOT DISTINCT FROM su LEFT JOIN u ON said = u.user_agent LEFT JOIN cl ON client_ip = li AND client_ua IS NOT DISTINCT FROM lu LEFT JOIN cnt ON client_ip = ci),
x1 AS (SELECT * EXCLUDE (med), med_ AS med, {age} AS age, n304 = 0 AND distinct_paths > 0 AND (again >= 20 OR n >= 500) AS hnc, (again >= 20 AND again >= n * 0.5) OR n >= 2000 AS refetch FROM x0),
x2 AS (SELECT *, {band} AS band FROM x1),
x3 AS (SELECT *, {scan} AS scan, {scrape} AS scrape, {crawl} AS crawl, {spoof} AS spoof, {", ".join(chain)} FROM x2),
x3b AS (SELECT *, {", ".join(f"({e})::DOUBLE AS w_{k}" for k, e in score.items())} FROM x3),
x4 AS (SELECT *, {", ".join(f"CASE WHEN w_{k} IS NOT NULL THEN round(greatest(least(w_{k}, 1), 0), 3) END AS r_{k}" for k in score)} FROM x3b),
x5 AS (SELECT *, {", ".join(f"CASE WHEN r_{k} IS NOT NULL THEN r_{k} END AS s_{k}" for k in score if k not in ("browser", "spoofed_browser"))},
  CASE WHEN r_spoofed_browser IS NULL AND r_browser IS NOT NULL THEN round(CASE WHEN dc THEN greatest(r_browser - 0.1, 0) ELSE r_browser END, 3) END AS s_browser,
  CASE WHEN NOT {_b('r_vuln_scanner >= 0.45')} THEN r_spoofed_browser END AS s_spoofed_browser FROM x4),
x6 AS (SELECT *, list_max(list_filter([{best}], lambda z: z.c IS NOT NULL)) AS best FROM x5),
x7 AS (SELECT *, CASE WHEN {_b('best.c >= 0.45')} THEN best.k WHEN {dcs} THEN 'scraper' WHEN {tell} OR dc THEN 'automation' ELSE 'unknown' END AS kind,
  CASE WHEN {_b('best.c >= 0.45')} THEN best.c WHEN {dcs} OR {tell} OR dc THEN 0.5 ELSE coalesce(best.c, 0) END AS confidence FROM x6),
k AS (SELECT *, list_sort(list_filter([{listed}], lambda z: z IS NOT NULL)) AS tags FROM x7)"""


def thresholds_sql() -> str:
    pool = "ua_browser AND n >= 5 AND page_count > 0 AND cold > 0.4 AND (n304 > 0 OR (referers > 0 AND follow > 0.3))"
    metric = {"rate": "peak_rpm", "bytes": "total_bytes / n", "breadth": "CASE WHEN n > 1 THEN turns / (n - 1) ELSE 0 END", "session": "duration"}
    cols = []
    for m, e in metric.items():
        part = f"quantile_disc(({e})::DOUBLE, 0.95)" if m == "breadth" else f"quantile_disc(({e})::DOUBLE, 0.95) FILTER ({e} > 0) * {C.MARGIN}"
        cols.append(f"round(CASE WHEN count(*) < {C.LEAST_POOL} THEN {C.FLOORS[m]} ELSE greatest({C.FLOORS[m]}, coalesce({part}, {C.FLOORS[m]})) END::DOUBLE, 6) AS t_{m}")
    return f"SELECT count(*) AS pool, {', '.join(cols)} FROM k WHERE {pool}"


def oracle_sql() -> dict[str, str]:
    key = "client_ip, client_ua"
    plain, routed = scored(), scored(True)
    robots_cte = f"rv AS (SELECT client_ip AS vi, client_ua AS vu, count_if(bad) AS hits_, bool_or(robots_file) AS got, count(*) AS asked FROM (SELECT *, CASE WHEN robots_file THEN FALSE WHEN contains(user_agent, 'GPTBot') THEN TRUE ELSE starts_with(path, '/shop/') AND NOT starts_with(path, '/shop/item1') END AS bad FROM f) GROUP BY ALL)"
    verdict = "CASE WHEN hits_ > 0 THEN 'ignores' WHEN got OR asked >= 5 THEN 'respects' ELSE 'unknown' END"
    quiet = "kind IN ('unknown', 'automation')"
    outlier = ", ".join(
        f"CASE WHEN n >= 5 AND ({m}) > t_{t}{q} THEN '{name}' END"
        for t, m, name, q in (("rate", "peak_rpm", "high-rate", ""), ("bytes", "total_bytes / n", "high-bytes", ""), ("breadth", "CASE WHEN n > 1 THEN turns / (n - 1) ELSE 0 END", "wide-breadth", f" AND NOT {quiet}"), ("session", "duration", "long-session", f" AND NOT {quiet}"))
    )
    observed = ", ".join(f"'{t}'" for t in C.OBSERVATIONAL)
    claims = " + ".join(f"coalesce(s_{x} >= 0.4, FALSE)::INT" for x in classify.SCORES)
    return reference() | {
        "coload": f"WITH RECURSIVE {FLAGS}, {COLOAD} SELECT li AS client_ip, lu AS client_ua, pages_total, pages_satisfied FROM cl",
        "client_kinds": f"{plain} SELECT {key}, kind, confidence::DOUBLE AS confidence FROM k",
        "client_scores": f"{plain} SELECT {key}, {', '.join(f's_{x}::DOUBLE AS s_{x}' for x in classify.SCORES)} FROM k",
        "tags_long": f"{plain} SELECT {key}, unnest(tags) AS tag FROM k",
        "kind_rollup": f"""{plain}, {robots_cte} SELECT kind, count(*) AS clients, sum(n)::BIGINT AS requests, sum(total_bytes)::BIGINT AS total_bytes, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
            count_if({verdict} = 'respects') AS respects_robots, count_if({verdict} = 'ignores') AS ignores_robots, count_if({verdict} = 'unknown') AS unknown_robots,
            0::BIGINT AS verified_clients, 0::BIGINT AS verified_requests, 0::BIGINT AS verified_bytes FROM k JOIN rv ON client_ip = vi AND client_ua IS NOT DISTINCT FROM vu GROUP BY kind""",
        "network_kind_rollup": f"{routed} SELECT network, kind, grouping(network)::INT AS all_networks, count(*) AS clients, sum(n)::BIGINT AS requests FROM k GROUP BY GROUPING SETS ((kind), (network, kind))",
        "network_matrix": f"""{routed}, m0 AS (SELECT kind, CASE WHEN network IS NULL THEN 'residential' ELSE 'datacenter' END AS category, coalesce(network, '{C.RESIDENTIAL}') AS net, sum(n)::BIGINT AS v FROM k GROUP BY ALL),
            m1 AS (SELECT *, sum(v) OVER (PARTITION BY kind) AS row_total, sum(v) OVER (PARTITION BY category, net) AS net_n, sum(v) OVER () AS total, max(category <> 'residential') OVER () AS mixed FROM m0),
            m2 AS (SELECT *, max(v >= row_total * {C.BREAKOUT_SHARE}) OVER (PARTITION BY category, net) AS big, dense_rank() OVER (PARTITION BY category ORDER BY net_n DESC, net) AS place FROM m1 WHERE mixed)
            SELECT kind, CASE WHEN category <> 'datacenter' OR place <= 2 OR (big AND net_n >= greatest(total * {C.GUARD_SHARE}, {C.GUARD_REQUESTS})) THEN net ELSE '{C.OTHER_HOSTING}' END AS "column", sum(v)::BIGINT AS requests FROM m2 GROUP BY ALL""",
        "relative_thresholds": f"{plain} {thresholds_sql()}",
        "relative_tags": f"{plain}, t AS ({thresholds_sql()}) SELECT {key}, array_to_string(list_sort(list_concat(tags, list_filter([{outlier}], lambda z: z IS NOT NULL))), ',') AS tags FROM k, t",
        "topk_per_kind": f"{plain} SELECT kind, {key}, n AS requests FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, client_ip, client_ua NULLS FIRST) <= 3",
        "actor_groups": f"""{plain}, a AS (SELECT said AS user_agent, array_to_string(list_filter(tags, lambda z: z NOT IN ({observed})), ',') AS actor_tags, n, client_ip FROM k)
            SELECT user_agent, actor_tags, count(*) AS members, sum(n)::BIGINT AS requests, max({{'n': n, 'ip': client_ip}}).ip AS lead_ip,
            substr(sha1(max({{'n': n, 'ip': client_ip}}).ip || '|' || coalesce(user_agent, '') || '|'), 1, 16) AS slug FROM a GROUP BY user_agent, actor_tags""",
        "score_conflicts": f"{plain} SELECT {key}, kind, ({claims})::INT AS claims FROM k WHERE ({claims}) >= 2",
        **more.oracle_sql(),
        **ranges.oracle_sql(),
        **signed.oracle_sql(),
        **runs.oracle_sql(),
        **views.oracle_sql(),
    }


def queries() -> dict:
    own = (
        kind_rollup, entry_flags, host_site_key, filter_vhost, skip_counters, ua_flags, ua_version_band, client_volume, iat_stats, breadth, referer_following,
        coload, request_buckets, ua_count_for_ip, range_attribution, route_fold, identity_subnet, redirect_shadow, robots_verdict, nonce_replay,
        client_scores, client_kinds, tags_long, network_kind_rollup, network_matrix, cadence_grid, relative_thresholds, relative_tags, topk_per_kind,
        actor_groups, score_conflicts,
    )
    return {f.__name__: f for f in own} | more.queries() | ranges.queries() | signed.queries() | runs.queries() | views.queries()
