"""Ranges and feeds against brute force over addresses as numbers."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from clientlens.functions.hosts import range_key
from clientlens.operators import intervals, network
from clientlens.sources import feeds


def key(n, v=4):
    return f"{'0' * 20}ffff{n:08x}" if v == 4 else f"{n:032x}"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        v = rng.choice([4, 6])
        width, base = (20, 10 << 24) if v == 4 else (70, 0x20010DB8 << 96)
        lo = base + rng.randrange(1 << width)
        hi = lo + rng.choice([0, 1, rng.randrange(1 << 8), rng.randrange(1 << (width - 4)), (1 << width)])
        rows.append((rng.randrange(6), rng.choice(["a", "b", None, "c"]), key(lo, v), key(hi, v)))
    rows += [(0, "back", key(500), key(400)), (0, "half", None, key(9)), rows[0], (None, "unranked", key(10 << 24), key((10 << 24) + 50))]
    points = [key((10 << 24) + rng.randrange(1 << 20)) for _ in range(300)] + [key((0x20010DB8 << 96) + rng.randrange(1 << 70), 6) for _ in range(300)]
    points += [b for r in rows for b in r[2:] if b] + [None]
    return rows, points


RANGE = "rank int, name string, lo string, hi string"


@pytest.mark.parametrize(("small", "per_slice"), [(10**6, 50), (0, 7), (0, 10**6)])
def test_first_range(spark, small, per_slice):
    rows, points = made(3, 80)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want = {}
    for i, p in enumerate(points):
        hits = [r for r in rows if p and r[2] and r[3] and r[2] <= p <= r[3]]
        if hits:
            want[i] = min(hits, key=order)[:2]
    got = intervals.first_range(spark.createDataFrame(list(enumerate(points)), "i int, key string"), spark.createDataFrame(rows, RANGE), small, per_slice).collect()
    assert {r["i"]: (r["rank"], r["name"]) for r in got} == want and len(got) == len(want) > 300
    none = spark.createDataFrame([], RANGE)
    assert intervals.first_range(spark.createDataFrame([(1, key(1))], "i int, key string"), none, small).count() == 0


def test_minimal_sets(spark):
    rows, _ = made(5, 60)
    got = {}
    for r in intervals.merged(spark.createDataFrame(rows, RANGE), "name").collect():
        got.setdefault(r["name"], []).append((int(r["lo"], 16), int(r["hi"], 16)))
    want: dict = {}
    for _, name, lo, hi in sorted((r for r in rows if r[2] and r[3] and r[2] <= r[3]), key=lambda r: r[2:]):
        mine, lo, hi = want.setdefault(name, []), int(lo, 16), int(hi, 16)
        if mine and lo <= mine[-1][1] + 1:
            mine[-1] = (mine[-1][0], max(hi, mine[-1][1]))
        else:
            mine.append((lo, hi))
    assert {k: sorted(v) for k, v in got.items()} == want
    edges = spark.createDataFrame([("x", "0" * 32, "0" * 31 + "f"), ("x", "0" * 30 + "10", "f" * 32), ("y", "f" * 32, "f" * 32)], "name string, lo string, hi string")
    assert sorted(tuple(r) for r in intervals.merged(edges, "name").collect()) == [("x", "0" * 32, "f" * 32), ("y", "f" * 32, "f" * 32)]


def test_own_ranges_and_mapped_addresses(spark):
    rows = [("a", key(10 << 24), key((10 << 24) + 255)), ("b", key((10 << 24) + 100), key((10 << 24) + 120)), ("a", key(0x20010DB8 << 96, 6), key((0x20010DB8 << 96) + 15, 6)), (None, key(0), key(2**32 - 1))]
    claims = [("a", "10.0.0.110"), ("b", "10.0.0.110"), ("b", "10.0.0.99"), ("a", "::ffff:10.0.0.7"), ("a", "2001:db8::f"), ("a", "2001:db8::10"), ("c", "10.0.0.1"), (None, "10.0.0.1"), ("a", "no address"), ("a", None)]
    got = network.in_own_ranges(spark.createDataFrame(claims, "agent string, client_ip string"), spark.createDataFrame(rows, "agent string, lo string, hi string"), "agent").collect()
    assert {tuple(r) for r in got} == {("a", "10.0.0.110"), ("b", "10.0.0.110"), ("a", "::ffff:10.0.0.7"), ("a", "2001:db8::f")}


TWO = ["198.51.100.0/25", "198.51.100.128/25"]  # merged to one
SIX = "2001:db8::/33"
LISTS = {
    "prefixes": json.dumps({"prefixes": [TWO[0], {"ipv4Prefix": TWO[1], "ipv6Prefix": SIX}, 7, None, {"x": 1}]}),
    "amazon": "<PRE><code lang=x>" + json.dumps({"prefixes": [{"ip_prefix": t} for t in TWO] + [{"ipv6_prefix": SIX}]}).replace('"', "&quot;") + "</code></PRE>",
    "aws": json.dumps({"prefixes": [{"ip_prefix": t, "region": "x"} for t in TWO], "ipv6_prefixes": [{"ipv6_prefix": SIX}]}),
    "azure": json.dumps({"values": [{"name": "a", "properties": {"addressPrefixes": TWO}}, {"properties": {"addressPrefixes": [SIX]}}, {}]}),
    "text": f"# comment\r\n{TWO[0]} # a\n\n  {TWO[1]}\n{SIX}\n",
    "csv": f"prefix,country\n{TWO[0]},DE,,\n{TWO[1]},\n{SIX},FR\n",
    "subnets": json.dumps({"subnets": [{"ip_prefix": t} for t in [*TWO, SIX]]}),
    "oracle": json.dumps({"regions": [{"region": "r", "cidrs": [{"cidr": t, "tags": []} for t in TWO]}, {"cidrs": [{"cidr": SIX}]}, {}]}),
    "ripestat": json.dumps({"data": {"prefixes": [{"prefix": t} for t in [*TWO, SIX]]}}),
}


def test_feed_formats(spark):
    rows = [(k, k, t) for k, t in LISTS.items()] + [("odd", "unknown", LISTS["prefixes"]), ("wide", "text", "0.0.0.0/1\n10.0.0.1\n300.1.1.1/8\n10.0.0.0/33"), ("broken", "aws", "{"), ("null", "csv", None), ("scalar", "prefixes", '{"prefixes": 5}')]
    whole, report = feeds.feed_intervals(spark.createDataFrame(rows, "feed string, kind string, text string"))
    got: dict = {}
    for r in whole.collect():
        got.setdefault(r["feed"], set()).add((r["lo"], r["hi"]))
    six = ipaddress.ip_network(SIX)
    want = {(key(int(ipaddress.ip_address("198.51.100.0"))), key(int(ipaddress.ip_address("198.51.100.255")))), (key(int(six[0]), 6), key(int(six[-1]), 6))}
    assert got == {k: want for k in [*LISTS, "odd"]}
    said = {r["feed"]: r for r in report.collect()}
    assert {k: r["problem"] for k, r in said.items()} == dict.fromkeys([*LISTS, "odd"]) | {"wide": "covers too much", "broken": "empty", "null": "empty", "scalar": "empty"}
    assert (said["wide"]["prefixes"], said["wide"]["malformed"], said["wide"]["intervals"]) == (2, 2, 1) and abs(said["aws"]["v4_share"] - 2.0**-24) < 1e-12


def test_prefix_bounds(spark):
    cidrs = ["10.1.2.3/8", "10.0.0.0/31", "1.2.3.4", "0.0.0.0/0", "2001:db8::/33", "::/0", "2001:db8::1", "fe80::/10"]
    lo, hi = network.cidr_bounds(F.col("c"))
    for r in spark.createDataFrame([(c,) for c in cidrs], "c string").select("c", lo.alias("lo"), hi.alias("hi"), range_key(F.split("c", "/")[0]).alias("k")).collect():
        net = ipaddress.ip_network(r["c"], strict=False)
        assert (r["lo"], r["hi"]) == (key(int(net[0]), net.version), key(int(net[-1]), net.version)), r["c"]
