"""Queries over whole runs on rotated log files, with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.operators import clients, network
from clientlens.plans import census, derived
from clientlens.plans.more import _PLAIN
from clientlens.sources import ends, logs
from clientlens.sources.shared import kept, shared_folder

#: Days of the month in each file; by name they are not in order of time.
FILES = {"access.log": (21, 31), "access.log.1": (11, 20), "access.log.2": (0, 10)}


def rotated(spark, d) -> str:
    """A folder of three files, the newest first by name."""
    folder = shared_folder(spark, "rotated")
    e = derived.log(spark, d).withColumn("t", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"))
    # lines are made by all tasks and once; the one task that writes a file only sorts them
    lines = kept(e.selectExpr("seq", "dayofmonth(ts) AS day", f"{_PLAIN} AS value"), "lines")
    for name, (a, b) in FILES.items():
        own = lines.where(F.col("day").between(a, b)).orderBy("seq").select("value")
        own.coalesce(1).write.text(f"{folder}/{name}")
    return folder


def _label(file):
    return F.regexp_extract(file, r"(access\.log(?:\.\d)?)/", 1)


def log_ends(spark, d) -> DataFrame:
    """Files in order of time by their ends, and whether a window of twelve days
    before the newest entry needs them."""
    parse = lambda lines: logs.parse_apache(lines)
    files = ends.list_files(spark, [rotated(spark, d)])
    order, start, found = ends.order_logs(spark, files, parse, 12 * 86400.0, from_latest=True)
    whole, _, _ = ends.order_logs(spark, files, parse)
    kept = {f for f, _ in order}
    span = {s["file"]: s for s in found}
    rows = [(k, f, span[f]["first"], span[f]["last"], f in kept) for k, (f, _) in enumerate(whole)]
    t = spark.createDataFrame(rows, "place int, file string, a bigint, b bigint, kept boolean")
    return t.select("place", _label(F.col("file")).alias("file"), F.timestamp_micros("a").alias("first"), F.timestamp_micros("b").alias("last"), "kept")


def _agents(spark) -> DataFrame:
    rows = [(0, "search_engine", "googlebot", ["crawl.example", "bot.example"], None, False), (1, "ai_crawler", "gptbot", None, [7], False)]
    return spark.createDataFrame(rows, "rank int, category string, token string, domains array<string>, asns array<bigint>, fallback boolean")


def _answers(spark, d) -> DataFrame:
    c = derived.log(spark, d).select(F.col("remote_host").alias("client_ip")).distinct()
    n = F.regexp_extract("client_ip", "([0-9]+)$", 1).cast("int")
    host = F.when(n % 4 == 1, F.lit("a.Crawl.example.")).when(n % 4 == 2, F.lit("evil.test")).when(n % 4 == 3, F.lit("bot.example"))
    forward = F.when(n % 3 != 1, F.array("client_ip")).otherwise(F.array(F.lit("192.0.2.1")))
    return c.select(F.col("client_ip").alias("ip"), host.alias("host"), (n % 8 == 0).alias("no_record"), forward.alias("forward"))


def whole_run(spark, d) -> DataFrame:
    """A run over the rotated files with checks by names and ranges: each client's
    verdicts, and its first target, which tells the order of files."""
    lo, hi = network.cidr_bounds(F.col("c"))
    own = spark.createDataFrame([("gptbot", "10.0.0.0/17"), ("gptbot", "2001:db8:50::/44")], "agent_token string, c string").select("agent_token", lo.alias("lo"), hi.alias("hi"))
    run = census.analyze(spark, [rotated(spark, d)], agents=_agents(spark), agent_ranges=own, answers=_answers(spark, d))
    first = run.entries.groupBy(*clients.KEY).agg(F.min_by("target", "seq").alias("first_target"))
    c = census.joined(run.clients, first, clients.KEY)
    sure = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, ("dns-verified", "ip-verified")))), F.lit(False)) & (F.col("kind") != "impersonator")
    return c.select(*clients.KEY, "requests", "identity", "dns_state", "range_state", (F.col("kind") == "impersonator").alias("impersonator"), sure.alias("verified"), "first_target")


def resident_agents(spark, d) -> DataFrame:
    """The feature is the limit: the first forty clients of the log."""
    return network.residents(derived.log(spark, d), ["remote_host", "user_agent"], 40)


def queries() -> dict:
    return {f.__name__: f for f in (log_ends, whole_run, resident_agents)}


_FILE = "CASE WHEN day(ts) <= 10 THEN 'access.log.2' WHEN day(ts) <= 20 THEN 'access.log.1' ELSE 'access.log' END"


def oracle_sql() -> dict[str, str]:
    log = f"log AS ({derived.SQL})"
    second = "date_trunc('second', ts)"
    return {
        "log_ends": f"""WITH {log}, s AS (SELECT {_FILE} AS file, arg_min({second}, seq) AS first, arg_max({second}, seq) AS last FROM log GROUP BY 1)
            SELECT (row_number() OVER (ORDER BY first) - 1)::INT AS place, file, first, CASE WHEN file IS NOT NULL THEN last END AS last, last >= max(last) OVER () - INTERVAL 12 DAY AS kept FROM s""",
        "whole_run": f"""WITH {log}, l AS (SELECT *, {_FILE} AS file, CASE WHEN query IS NOT NULL AND query <> '' THEN path || '?' || query ELSE path END AS target,
              user_agent || CASE WHEN seq % 13 = 0 THEN ' "x"' ELSE '' END AS ua, contains(user_agent, 'Googlebot') AS g, contains(user_agent, 'GPTBot') AS b FROM log),
            c AS (SELECT remote_host AS client_ip, ua AS client_ua, count(*) AS requests, any_value(g) AS g, any_value(b) AS b, arg_min(target, (CASE file WHEN 'access.log.2' THEN 0 WHEN 'access.log.1' THEN 1 ELSE 2 END) * 1000000000 + seq) AS first_target FROM l GROUP BY ALL),
            n AS (SELECT *, regexp_extract(client_ip, '([0-9]+)$', 1)::INT AS n FROM c),
            v AS (SELECT *, CASE WHEN g THEN CASE n % 4 WHEN 2 THEN 'fail' WHEN 0 THEN CASE WHEN n % 8 = 0 THEN 'fail' ELSE 'unknown' END ELSE CASE WHEN n % 3 <> 1 THEN 'pass' ELSE 'fail' END END END AS dns_state,
              CASE WHEN b THEN CASE WHEN (NOT contains(client_ip, ':') AND split_part(client_ip, '.', 2) = '0' AND split_part(client_ip, '.', 3)::INT < 128) OR (contains(client_ip, ':') AND starts_with(split_part(client_ip, ':', 3), '5') AND length(split_part(client_ip, ':', 3)) = 2) THEN 'pass' ELSE 'fail' END END AS range_state FROM n),
            w AS (SELECT *, CASE coalesce(dns_state, range_state) WHEN 'pass' THEN 'verified' WHEN 'fail' THEN 'impersonator' WHEN 'unknown' THEN 'unverified' END AS identity FROM v)
            SELECT client_ip, client_ua, requests, identity, dns_state, range_state, coalesce(identity = 'impersonator', FALSE) AS impersonator, coalesce(identity = 'verified', FALSE) AS verified, first_target FROM w""",
        "resident_agents": f"WITH {log}, f AS (SELECT remote_host, user_agent, min(seq) AS s FROM log GROUP BY ALL) SELECT remote_host, user_agent FROM f ORDER BY s LIMIT 40",
    }
