"""A web log derived from the ``events`` table, by the same expressions in Spark
and in the reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/60.0",
    "Mozilla/5.0 (Macintosh) AppleWebKit/605.1 (KHTML, like Gecko) Version/17.1 Safari/605.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "GPTBot/1.2 (+https://openai.com/gptbot)",
    "curl/8.4.0",
    "",
    "FreshRSS/1.24 (Linux)",
]
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
PAGE = f"concat('/page', CAST({K} % 20 AS STRING), '.html')"
COLUMNS = {
    "seq": "event_id",
    "ts": "ts",
    "remote_host": "CASE WHEN user_id % 11 = 10 THEN concat('2001:db8:', CAST(user_id % 90 + 10 AS STRING), ':1::', CAST(1 + user_id % 7 AS STRING)) "
    "ELSE concat('10.', CAST(CAST(floor(user_id / 250.0) AS BIGINT) % 250 AS STRING), '.', CAST(user_id % 250 AS STRING), '.', CAST(1 + user_id % 7 AS STRING)) END",
    "method": f"CASE WHEN event_type = 'signup' AND user_id % 4 = 1 THEN 'POST' WHEN {K} % 17 = 0 THEN 'HEAD' ELSE 'GET' END",
    "path": f"CASE event_type WHEN 'view' THEN {PAGE} WHEN 'click' THEN concat('/static/a', CAST({K} % 10 AS STRING), '.css') "
    f"WHEN 'purchase' THEN concat('/shop/item', CAST({K} % 30 AS STRING)) WHEN 'signup' THEN '/register' "
    f"ELSE CASE WHEN {K} % 29 = 5 THEN '/robots.txt' WHEN user_id % 8 = 7 THEN '/feed/index.xml' WHEN user_id % 5 = 3 AND {K} % 5 = 0 THEN '/wp-login.php' WHEN user_id % 5 = 3 AND {K} % 5 = 1 THEN '/.env' "
    f"ELSE concat('/gone/', CAST({K} AS STRING)) END END",
    "query": f"CASE WHEN {K} % 4 = 0 THEN concat('q=', CAST({K} AS STRING)) WHEN user_id % 5 = 3 AND {K} % 31 = 7 THEN 'f=../../etc/passwd' WHEN user_id % 5 = 3 AND {K} % 31 = 9 THEN 'p=%252e' END",
    "status": f"CASE WHEN event_type = 'error' AND {K} % 29 = 5 THEN 200 WHEN event_type = 'error' AND {K} % 13 = 2 THEN 403 WHEN event_type = 'error' AND (user_id % 5 = 3 OR {K} % 4 = 0) THEN 404 WHEN {K} % 10 = 3 THEN 304 WHEN {K} % 25 = 1 THEN 301 ELSE 200 END",
    "bytes_sent": "CAST(floor(value * 100) AS BIGINT)",
    "referer": f"CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND {K} % 2 = 0) THEN concat('https://www.example.org', {PAGE}) "
    f"WHEN event_type = 'view' AND user_id % 9 = 0 AND {K} % 3 = 0 THEN concat('https://example.org', {PAGE}, '?r=1') END",
    "user_agent": "CASE user_id % 8 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS)) + " END",
    "host_header": "CASE user_id % 3 WHEN 0 THEN 'www.example.org:443' WHEN 1 THEN 'Example.org' ELSE 'blog.example.net' END",
}
SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM events"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # K once a row, not once in every branch that reads it
    found = events.withColumn("_k", F.expr(K))
    return found.selectExpr(*[f"CAST({e} AS TIMESTAMP) AS {c}" if c == "ts" else f"{e.replace(K, '_k')} AS {c}" for c, e in COLUMNS.items()])
