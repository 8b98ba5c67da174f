"""Traces, patterns, clusters and majorities against plain models."""

import random

from pyspark.sql import functions as F

from clientlens.operators import calibrate, inspect


def forest(rows):
    """(depth, offset) of each entry, as a reader of the log would nest them."""
    base = page = next((t for _, t, *_ in rows if t is not None), None)
    known, out = {}, []
    for _, t, static, path, ref in rows:
        depth = known[ref] + 1 if static and ref in known else 0
        origin = page if depth else base
        out.append((depth, None if t is None or origin is None else t - origin))
        if depth:
            known.setdefault(path, depth)
        else:
            base = t if t is not None else base
            if not static:
                known = {path: 0}
                page = t if t is not None else page
    return out


def test_forest_against_a_model(spark):
    rng, rows, want = random.Random(3), [], {}
    for c in range(60):
        t, mine = 0, []
        for i in range(rng.randrange(1, 40)):
            t += rng.choice([0, 1, 5])
            static = rng.random() < 0.7
            path = f"/{rng.choice('abc')}" + (".css" if static else "")
            ref = rng.choice([None, "/a", "/b", "/a.css", "/b.css", "/c.css"])
            mine.append((i, None if rng.random() < 0.05 else t, static, path, ref))
        mine.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
        for place, (r, d) in enumerate(zip(mine, forest(mine), strict=True), 1):
            want[str(c), r[0]] = (place, *d)
        rows += [(str(c), None, *r) for r in mine]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "client_ip string, client_ua string, seq int, t int, static boolean, path string, ref_path string")
    d = d.withColumns({"ts": F.timestamp_seconds(F.col("t") + 1_000_000), "has_referer": F.col("ref_path").isNotNull()})
    got = {(r["client_ip"], r["seq"]): (r["place"], r["depth"], r["offset"]) for r in inspect.cascade(d).collect()}
    assert got == want and {d for _, d, _ in want.values()} >= {0, 1, 2, 3}


def test_no_request_is_lost_on_the_axis(spark):
    c = spark.createDataFrame([("a", None, 0, 4000, 90), ("b", "u", 1000, 1030, 7), ("c", None, 4000, 4000, 1)], "client_ip string, client_ua string, x int, y int, requests long")
    c = c.withColumns({"first_seen": F.timestamp_seconds("x"), "last_seen": F.timestamp_seconds("y"), "duration": (F.col("y") - F.col("x")).cast("double")})
    b = spark.createDataFrame([("a", None, k, 2 + k % 3) for k in range(30)], "client_ip string, client_ua string, bucket int, requests long")
    placed = inspect.on_axis(c, b).collect()
    assert {(r["client_ip"], r["slot"]): r["requests"] for r in placed if r["client_ip"] != "a"} == {("b", 10): 7, ("c", 39): 1}
    assert sorted((r["slot"], r["requests"]) for r in placed if r["client_ip"] == "a") == [(k, 2 + k % 3) for k in range(30)]
    p = inspect.patterns(inspect.on_axis(c, b), c.withColumn("actor", F.lit("x"))).collect()
    assert sum(r["requests"] for r in p) == 98 and {r["peak"] for r in p} == {10}
    assert inspect.on_axis(c.where("client_ip = 'c'"), b).count() == 0  # no span, no axis


def test_clusters_and_ties(spark):
    rows = [("x", 5, "k1", "u1"), ("x", 5, "k2", None), ("y", 10, "k1", "u2"), ("z", 3, "k1", "u3"), ("w", 1, "k3", "u3"), (None, 99, "k1", "u1")]
    c = spark.createDataFrame(rows, "key string, requests long, kind string, user_agent string")
    got = [tuple(r) for r in calibrate.clusters(c, F.lit("s"), F.col("key"), top=2).orderBy("place").collect()]
    assert got == [("s", 1, "x", 10, 2, "k1 x1, k2 x1", "- x1, u1 x1", 2), ("s", 2, "y", 10, 1, "k1 x1", "u2 x1", 2)]
    assert calibrate.clusters(c.where("false"), F.lit("s"), F.col("key")).count() == 0


def test_majorities_are_strict(spark):
    m = spark.createDataFrame([("f", None, str(k)) for k in range(4)] + [("g", "u", "0"), ("g", "u", "1"), ("h", None, "9")], "client_ip string, client_ua string, ip string")
    c = spark.createDataFrame([("0", "DE", False), ("1", "FR", False), ("2", "DE", None), ("3", "FR", True), ("9", None, False)], "ip string, country string, suppressed boolean")
    assert [tuple(r) for r in calibrate.member_countries(m, c).collect()] == [("f", None, "DE")]
    e = spark.createDataFrame([("a.org",), ("a.org",), ("b.org",), (None,)], "ref_host string")
    assert [r["site"] for r in calibrate.site_host(e).collect()] == ["a.org"] and calibrate.site_host(e.where("ref_host is null")).count() == 0
    assert calibrate.site_host(e.union(spark.createDataFrame([("b.org",)], "ref_host string"))).count() == 0


def test_the_group_shown_is_the_first_in_the_file(spark):
    from clientlens.operators import robots

    text = "User-agent: Google\nCrawl-delay: 5\nUser-agent: Googlebot\nUser-agent: x\nCrawl-delay: 9 # s\n\nUser-agent: *\nCrawl-delay: two\n"
    assert robots.groups(text) == [("Google", 5), ("Googlebot", 9), ("x", 9), ("*", None)]
    c = spark.createDataFrame([("Googlebot", 6.0), ("X", 8.0), ("other", 1.0), (None, None), ("x", None)], "product string, iat_median double")
    got = [tuple(r) for r in robots.with_delay(c, text).select("crawl_delay", "matched_group", "delay_respected").collect()]
    assert got == [(5.0, "Google", True), (9.0, "x", False), (None, "*", None), (None, "*", None), (9.0, "x", None)]
    assert robots.with_delay(c, "").where("crawl_delay is not null or matched_group is not null").count() == 0
