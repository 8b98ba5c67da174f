"""The census: parsing, features against a plain model, and whole runs."""

import gzip
import math
import random
import statistics
from collections import deque

import pytest
from pyspark.sql import functions as F

from clientlens.operators import clients, network, robots, rollup
from clientlens.plans import census, queries
from clientlens.sources import logformat, logs

LINES = [
    '192.0.2.1 - - [10/Oct/2023:13:55:36 +0000] "GET /a.html?x=1 HTTP/1.1" 200 2326 "http://e.org/b" "Mozilla/5.0 (X) Gecko Firefox/118.0"',
    '192.0.2.1 - bob [10/Oct/2023:15:55:37 +0200] "GET /s.css HTTP/1.1" 200 - "http://e.org/a.html" "-"',
    r'192.0.2.2 - - [10/Oct/2023:13:55:38 +0000] "\x16\x03" 400 0 "-" "a \"quoted\" agent"',
    '192.0.2.3 - - [10/Oct/2023:13:55:39 +0000] "GET / HTTP/1.1" 200 5',
    "garbage",
    "",
]


@pytest.fixture
def log_file(tmp_path):
    p = tmp_path / "a.log.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join(LINES) + "\n")
    return str(p)


def test_combined_lines(spark, log_file):
    e = logs.read_log(spark, [log_file]).orderBy("seq").collect()
    assert len(e) == 5 and [r["skip_reason"] for r in e] == [None] * 4 + ["unmatched_line"]
    assert (e[0]["path"], e[0]["query"], e[0]["status"], e[0]["bytes_sent"], e[0]["referer"]) == ("/a.html", "x=1", 200, 2326, "http://e.org/b")
    assert e[1]["bytes_sent"] == 0 and e[1]["user_agent"] is None and e[1]["remote_user"] == "bob"
    assert (e[1]["ts"] - e[0]["ts"]).total_seconds() == 1
    assert e[2]["user_agent"] == 'a "quoted" agent' and e[2]["path"] == "" and e[2]["raw_request"]
    assert e[3]["user_agent"] is None and e[3]["referer"] is None and e[3]["bytes_sent"] == 5


def test_a_path_given_twice_counts_twice(spark, log_file):
    assert logs.read_log(spark, [log_file, log_file]).count() == 10
    c = logs.skip_counts(logs.read_log(spark, [log_file])).first()
    assert (c["total"], c["parsed"], c["skipped"], c["first_skipped"]) == (5, 4, 1, "garbage")


def test_bad_formats():
    for bad in ("%h%u", "%y", "%h %"):
        with pytest.raises(logformat.LogFormatError):
            logformat.pattern(logformat.tokenize(bad))
    assert [t.letter for t in logformat.tokenize("%>s %%%U%q")] == ["s", "", "U", "q"]


def test_cloudflare(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(
        '{"ClientIP":"1.2.3.4","ClientRequestMethod":"GET","ClientRequestURI":"/p?q=1","EdgeResponseStatus":200,"EdgeStartTimestamp":1700000000000000000,"ClientASN":13}\n'
        '{"ClientIP":"1.2.3.4","EdgeStartTimestamp":"2023-11-14T22:13:20Z"}\nnot json\n'
    )
    a, b, c = logs.read_log(spark, [str(p)], source="cloudflare").orderBy("seq").collect()
    assert (a["path"], a["query"], a["extra"]) == ("/p", "q=1", {"asn": "13"}) and a["ts"] == b["ts"]
    assert c["skip_reason"] == "invalid_json"


def model(rows):
    """Co-load by the letter: one queue of waiting pages, evicted from the front."""
    waiting, hits, pages = deque(), 0, 0
    for t, kind, path in rows:
        while waiting and waiting[0][0] < t - 10:
            waiting.popleft()
        if kind == "P":
            waiting.append((t, path))
            pages += 1
        elif kind == "A":
            for i, (_, p) in enumerate(waiting):
                if p == path:
                    del waiting[i]
                    hits += 1
                    break
    return pages, hits


def test_coload_against_model(spark):
    rng, rows, want = random.Random(4), [], {}
    for c in range(40):
        t, mine = 0.0, []
        for _ in range(rng.randrange(1, 30)):
            t += rng.choice([0, 1, 4, 12, -8])
            mine.append((t, rng.choice("PAO"), rng.choice("xyz")))
        want[str(c)] = model(mine)
        rows += [(str(c), i, t, k, p) for i, (t, k, p) in enumerate(mine)]
    d = spark.createDataFrame(rows, "client_ip string, seq int, t double, k string, p string")
    e = d.select(
        "client_ip", F.lit(None).cast("string").alias("client_ua"), "seq", F.timestamp_seconds(F.col("t") + 1e6).alias("ts"), (F.col("k") == "P").alias("page"),
        F.lit("t").alias("top"), F.lit(False).alias("robots_file"), (F.col("k") == "A").alias("static"), F.lit(False).alias("chrome_asset"), (F.col("k") == "A").alias("has_referer"), F.col("p").alias("path"), F.col("p").alias("ref_path"),
    )
    got = {r["client_ip"]: (r["pages_total"], r["pages_satisfied"]) for r in clients.coload(e).collect()}
    assert {c: got.get(c, (0, 0)) for c in want} == want


def measured(rows):
    """Order-dependent measures by the letter."""
    newest, deltas, turns, prev, first, content, robots = None, [], 0, None, set(), False, False
    followed = 0
    for t, path, static, ref in rows:
        top = path.split("/")[1]
        turns += prev is not None and prev != top
        prev = top
        if path == "/robots.txt":
            robots |= not content
        else:
            content = True
        followed += ref is not None and ref != path and ref in first
        first.add(path)
        if not static:
            if newest is not None and t >= newest:
                deltas.append(t - newest)
            newest = t if newest is None else max(newest, t)
    return deltas, turns, robots, followed


def quantile(deltas, q):
    buckets = sorted(0 if d <= 0 else max(1, min(int((math.log10(d) + 3) * 10) + 1, 101)) for d in deltas)
    b = buckets[max(math.ceil(q * len(buckets)), 1) - 1]
    return 10 ** (-3 + (b - 0.5) / 10) if b else 0.0


def test_a_busy_client_is_cut_into_slices(spark):
    """Two clients with nearly all of the log: the same measures from one slice and from many."""
    rng, logs_ = random.Random(8), {}
    for ip, n in (("a", 900), ("b", 2), ("c", 700), ("d", 1), ("e", 257), ("f", 256)):
        t, mine = 0, []
        for i in range(n):
            t += rng.choice([0, 1, 2, 3, 7, 40, -5])
            static = rng.random() < 0.4
            path = "/robots.txt" if i == 0 and ip in "ad" else f"/{rng.choice('xy')}/{rng.randrange(9)}{'.css' if static else '.html'}"
            mine.append((t, path, static, f"/{rng.choice('xy')}/{rng.randrange(9)}.html" if rng.random() < 0.6 else None))
        logs_[ip] = mine
    rows = [(ip, None, i, 1_000_000 + t, p, s, r) for ip, mine in logs_.items() for i, (t, p, s, r) in enumerate(mine)]
    d = spark.createDataFrame(rows, "client_ip string, client_ua string, seq int, t long, path string, static boolean, ref_path string")
    e = d.select(
        "client_ip", "client_ua", "seq", F.timestamp_seconds("t").alias("ts"), "path", "static", "ref_path", F.col("ref_path").isNotNull().alias("has_referer"), F.split("path", "/")[1].alias("top"),
        (F.col("path") == "/robots.txt").alias("robots_file"), (~F.col("static")).alias("page"), F.lit(False).alias("chrome_asset"),
    )
    for parts in (1, 7, 40):
        o = clients.with_order(e, parts)
        gaps = {r["client_ip"]: r for r in clients.gaps(o).collect()}
        load = {r["client_ip"]: (r["pages_total"], r["pages_satisfied"]) for r in clients.coload_ordered(o).collect()}
        own = {r[0]: tuple(r)[1:] for r in o.groupBy("client_ip").agg(F.count_if("turned"), F.bool_or("robots_first"), F.count_if("followed")).collect()}
        if parts > 1:
            assert o.groupBy("client_ip").agg(F.count_distinct("_part").alias("n")).where("client_ip in ('a', 'c') and n > 1").count() == 2
        for ip, mine in logs_.items():
            deltas, turns, robots_, followed = measured(mine)
            assert own[ip] == (turns, robots_, followed), (parts, ip)
            assert load[ip] == model([(t, "A" if s and r else "O" if s else "P", (r if s else p)) for t, p, s, r in mine]), (parts, ip)
            if not deltas:
                assert ip not in gaps
                continue
            g = gaps[ip]
            assert (g["iat_n"], g["iat_min"]) == (len(deltas), min(deltas)) and abs(g["iat_mean"] - sum(deltas) / len(deltas)) < 1e-9
            want = (statistics.median(deltas), sorted(deltas)[round(0.95 * (len(deltas) - 1))]) if len(deltas) <= 256 else (quantile(deltas, 0.5), quantile(deltas, 0.95))
            assert all(abs(x - y) < 1e-9 for x, y in zip((g["iat_median"], g["iat_p95"]), want, strict=True)), (parts, ip)


def test_whole_run(spark, tmp_path):
    lines = []
    for k in range(6):
        lines.append(f'10.0.0.1 - - [10/Oct/2023:13:0{k}:00 +0000] "GET /p{k}.html HTTP/1.1" 200 10 "http://e.org/p{max(k - 1, 0)}.html" "Mozilla/5.0 AppleWebKit/600 Chrome/117.0"')
        lines.append(f'10.0.0.1 - - [10/Oct/2023:13:0{k}:02 +0000] "GET /s{k}.css HTTP/1.1" 304 0 "http://e.org/p{k}.html" "Mozilla/5.0 AppleWebKit/600 Chrome/117.0"')
        lines.append(f'10.0.0.2 - - [10/Oct/2023:13:0{k}:00 +0000] "GET /{[".env", ".git/config", "id_rsa", "shell", "wp-config.php", "boaform"][k]} HTTP/1.1" 404 1 "-" "x"')
        lines.append(f'66.249.66.{k} - - [10/Oct/2023:13:0{k}:00 +0000] "GET /private/{k} HTTP/1.1" 200 1 "-" "Mozilla/5.0 (compatible; Googlebot/2.1)"')
    p = tmp_path / "x.log"
    p.write_text("\n".join(lines) + "\n")
    out = census.analyze(spark, [str(p)], robots_text="User-agent: Googlebot\nDisallow: /private/\n")
    got = {r["client_ip"]: (r["kind"], r["requests"]) for r in out.clients.collect()}
    assert got == {"10.0.0.1": ("browser", 12), "10.0.0.2": ("vuln_scanner", 6), "66.249.66.0/24": ("search_engine", 6)}
    tags = {r["client_ip"]: r["tags"] for r in out.clients.collect()}
    assert "loads-assets" in tags["10.0.0.1"] and "ignores-robots" in tags["66.249.66.0/24"] and "ignores-robots" not in tags["10.0.0.2"]
    assert {r["kind"]: r["requests"] for r in out.kinds.collect()} == {"browser": 12, "vuln_scanner": 6, "search_engine": 6}
    text = census.markdown(out)
    assert "| browser | 1 | 12 |" in text and "66.249.66.0/24" in text


def test_addresses(spark):
    d = spark.createDataFrame([("::ffff:1.2.3.4",), ("1.2.3.4",), ("2001:db8::1",), ("x",), (None,)], "ip string")
    from clientlens.functions.hosts import range_key, subnet

    got = d.select(subnet(F.col("ip")).alias("s"), range_key(F.col("ip")).alias("k")).collect()
    assert got[0] == got[1] and got[0]["s"] == "1.2.3.0/24" and got[0]["k"] == "00000000000000000000ffff01020304"
    assert got[2]["s"] == "2001:db8:0::/48" and got[2]["k"] == "20010db8000000000000000000000001"
    assert got[3]["s"] is None and got[4]["k"] is None
    b = spark.createDataFrame([("10.0.0.0/9",), ("2001:db8::/33",)], "c string").select(*network.cidr_bounds(F.col("c"))).collect()
    assert b[0][0].endswith("ffff0a000000") and b[0][1].endswith("ffff0a7fffff") and b[1][1] == "20010db87" + "f" * 23


def test_robots_rules():
    assert robots.parse("User-agent: A\nUser-agent: b\nDisallow: /x # c\nAllow:\n\nUser-agent: *\nAllow: /y$") == [("a", False, "/x"), ("b", False, "/x"), ("*", True, "/y$")]
    assert robots.as_regex("/a*b$") == "^/a.*b$"


def test_every_query_has_rows(spark):
    for name in ("kind_rollup", "tags_long", "network_matrix", "topk_per_kind"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_matrix_holds_every_request(spark):
    rows = [("browser", "a", None, 5000), ("browser", "b", None, 4000), ("browser", "c", None, 300), ("feed_reader", "c", None, 90), ("monitor", "d", None, 90),
            ("browser", None, "relay", 70), ("browser", "a", "relay", 30), ("app", None, None, 25), ("browser", None, None, 6000)]
    t = spark.createDataFrame(rows, "kind string, network string, egress string, requests bigint")
    got = {(r["kind"], r["column"]): r["requests"] for r in rollup.matrix(t, 2).collect()}
    assert got == {
        ("browser", "a"): 5000, ("browser", "b"): 4000, ("browser", "c"): 300, ("feed_reader", "c"): 90, ("monitor", "Other"): 90,
        ("browser", "relay"): 100, ("app", "Residential / unknown"): 25, ("browser", "Residential / unknown"): 6000,
    }
    assert rollup.matrix(t.where("network is null and egress is null")).count() == 0
