"""Address databases that the test writes itself, read back interval for interval."""

import ipaddress
import json
import struct

import pytest

from clientlens.operators import intervals
from clientlens.sources import mmdb


def encoded(v) -> bytes:
    def head(kind, size):
        first, more = (size, b"") if size < 29 else (29, bytes([size - 29])) if size < 285 else (30, (size - 285).to_bytes(2, "big"))
        return (bytes([kind << 5 | first]) if kind < 8 else bytes([first, kind - 7])) + more

    if isinstance(v, bool):
        return head(14, int(v))
    if isinstance(v, str):
        return head(2, len(v.encode())) + v.encode()
    if isinstance(v, float):
        return head(3, 8) + struct.pack(">d", v)
    if isinstance(v, int):
        raw = v.to_bytes((v.bit_length() + 7) // 8, "big")
        return head(6, len(raw)) + raw
    if isinstance(v, list):
        return head(11, len(v)) + b"".join(map(encoded, v))
    return head(7, len(v)) + b"".join(encoded(k) + encoded(x) for k, x in v.items())


def written(path, networks, version=6, bits=28, kind="Test-ASN", aliases=()):
    """A database of {prefix: record}; prefixes must not overlap."""
    root: list = [None, None]
    for net, record in networks.items():
        net = ipaddress.ip_network(net)
        value, n = int(net.network_address), net.prefixlen
        width = net.max_prefixlen
        if version == 6 and net.version == 4:
            n, width = n + 96, 128
        node = root
        for i in range(n):
            side = value >> (width - 1 - i) & 1
            if i == n - 1:
                node[side] = json.dumps(record)
            else:
                node[side] = node[side] if isinstance(node[side], list) else [None, None]
                node = node[side]
    for alias in aliases:  # another way to the addresses of version 4
        four = root
        for _ in range(96):
            four = four[0]
        net, node = ipaddress.ip_network(alias), root
        for i in range(net.prefixlen):
            side = int(net.network_address) >> (127 - i) & 1
            if i == net.prefixlen - 1:
                node[side] = four
            else:
                node[side] = node[side] if isinstance(node[side], list) else [None, None]
                node = node[side]
    order, seen, stack = [], {}, [root]
    while stack:
        node = stack.pop()
        if id(node) not in seen:
            seen[id(node)] = len(order)
            order.append(node)
            stack += [x for x in node if isinstance(x, list)]
    data, places, first = b"", {}, None
    for node in order:
        for x in node:
            if isinstance(x, str) and x not in places:
                places[x] = len(data)
                r = json.loads(x)
                if first is not None and "shared" in r:  # a pointer to a value before
                    data += bytes([7 << 5 | 1]) + encoded("shared") + bytes([1 << 5 | first >> 8, first & 255])
                else:
                    if "shared" in r:
                        first = len(data) + 1 + len(encoded("shared"))
                    data += encoded(r)

    def number(x):
        return len(order) if x is None else seen[id(x)] if isinstance(x, list) else len(order) + 16 + places[x]

    tree = b""
    for a, b in order:
        a, b = number(a), number(b)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    meta = {"node_count": len(order), "record_size": bits, "ip_version": version, "database_type": kind, "languages": ["en"], "build_epoch": 1700000000}
    path.write_bytes(tree + b"\0" * 16 + data + mmdb.MARK + encoded(meta))


def key(ip):
    ip = ipaddress.ip_address(ip)
    return f"{'0' * 20}ffff{int(ip):08x}" if ip.version == 4 else f"{int(ip):032x}"


def bounds(net):
    net = ipaddress.ip_network(net)
    return key(net[0]), key(net[-1])


AS = lambda n: {"autonomous_system_number": n, "autonomous_system_organization": f"Org {n}"}
NETS = {
    "1.0.0.0/24": AS(13335), "1.0.1.0/24": AS(13335), "10.0.0.0/9": AS(7), "10.128.0.0/10": {"shared": "a long value that two records share"}, "203.0.113.7/32": AS(9),
    "192.0.2.0/24": {"shared": "a long value that two records share"}, "2001:db8::/48": AS(11), "2a00::/16": {"country": {"iso_code": "DE", "names": {"en": "Germany", "de": "D"}}, "traits": {"is_anycast": True}}, "fe80::1/128": {"x": [1, 2.5, True, {"y": ""}], "big": 2**40},
}


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_reads_back_interval_for_interval(spark, tmp_path, bits):
    written(tmp_path / "a.mmdb", NETS, bits=bits, aliases=["2002::/16", "::ffff:0:0/96"])
    got = {(r["lo"], r["hi"]): r for r in mmdb.read_mmdb(spark, f"{tmp_path}/a.mmdb").collect()}
    want = {bounds(n): r for n, r in NETS.items() if not n.startswith("1.0.")}
    want[key("1.0.0.0"), key("1.0.1.255")] = AS(13335)  # neighbours with one record
    assert {k: json.loads(r["record"]) for k, r in got.items()} == want
    one = got[bounds("2a00::/16")]
    assert (one["country"], one["country_name"], one["suppressed"], one["asn"]) == ("DE", "Germany", True, None)
    assert got[bounds("10.0.0.0/9")]["asn"] == 7 and got[bounds("10.0.0.0/9")]["as_org"] == "Org 7"


def test_version_four_and_lookup(spark, tmp_path):
    nets = {n: r for n, r in NETS.items() if ":" not in n}
    written(tmp_path / "b.mmdb", nets, version=4, bits=24)
    table = mmdb.read_mmdb(spark, f"{tmp_path}/b.mmdb").selectExpr("0 AS rank", "as_org AS name", "lo", "hi")
    ips = ["10.1.2.3", "1.0.1.255", "1.0.2.0", "203.0.113.7", "203.0.113.8"]
    points = spark.createDataFrame([(i, key(i)) for i in ips], "ip string, key string")
    for small in (0, 100):
        got = {r["ip"]: r["name"] for r in intervals.first_range(points, table, small=small).collect()}
        assert got == {"10.1.2.3": "Org 7", "1.0.1.255": "Org 13335", "203.0.113.7": "Org 9"}


def test_discovery_goes_by_type(spark, tmp_path):
    for name, kind in (("a", "GeoLite2-City"), ("b", "X-Country"), ("c", "GeoIP2-Enterprise"), ("d", "DBIP-ISP")):
        written(tmp_path / f"{name}.mmdb", {"10.0.0.0/8": AS(1)}, kind=kind)
    (tmp_path / "e.mmdb").write_bytes(b"broken")
    found = mmdb.discover(spark, str(tmp_path))
    assert found["asn"].endswith("/d.mmdb") and found["country"].endswith("/b.mmdb")
