"""One run with every table that a run can take."""

import base64

from pyspark.sql import functions as F

from clientlens.operators import network, rollup
from clientlens.plans import census
from clientlens.plans import signed as made

FORMAT = '%a %t "%r" %>s %B "%{Referer}i" "%{User-Agent}i" "%{Host}i" "%{Signature-Input}i" "%{Signature}i"'
CHROME = "Mozilla/5.0 (X11) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/117.0 Safari/537.36"


def line(ip, at, path, status=200, size=100, referer="-", agent="-", host="www.e.org", signature=("-", "-")):
    quote = lambda s: s.replace('"', '\\"')
    return f'{ip} [{10 + at // 86400:02d}/Oct/2023:{at // 3600 % 24:02d}:{at // 60 % 60:02d}:{at % 60:02d} +0000] "GET {path} HTTP/1.1" {status} {size} "{referer}" "{agent}" "{host}" "{quote(signature[0])}" "{quote(signature[1])}"'


def signed(seed, good=True):
    params = f'("@authority");created=1;keyid="{made._keyid(made.SEEDS[seed])}";tag="web-bot-auth"'
    base = f'"@authority": {"www.e.org" if good else "other.org"}\n"@signature-params": {params}'
    return f"s={params}", f"s=:{base64.b64encode(made.sign(made.SEEDS[seed], base.encode())).decode()}:"


def bounds(spark, rows, schema):
    lo, hi = network.cidr_bounds(F.col("cidr"))
    return spark.createDataFrame(rows, schema).withColumns({"lo": lo, "hi": hi}).drop("cidr")


def test_run_with_everything(spark, tmp_path):
    rows = []
    for k in range(34):
        for p in range(6):
            at = 600 * p + k
            rows.append((at, line(f"10.0.0.{k}", at, f"/p{p}.html", 200 if p else 304, 500_000_000 if k == 33 else 100, f"http://www.e.org/p{p - 1}.html" if p else "-", CHROME)))
            rows.append((at + 1, line(f"10.0.0.{k}", at + 1, f"/s{p}.css", 304, 0, f"http://www.e.org/p{p}.html", CHROME)))
    for k, (ip, agent, mark) in enumerate([
        ("10.1.0.1", "signedbot/1.0", signed(0)), ("10.1.0.2", "signedbot/1.0", signed(0, good=False)), ("66.249.0.1", "Googlebot/2.1", None), ("66.249.0.2", "Googlebot/2.1", None),
        ("10.2.0.1", "-", None), ("10.3.0.1", "GPTBot/1.0", None), ("10.5.0.1", "curl/8.0", None),
    ]):
        rows += [(50 + k + 40 * j, line(ip, 50 + k + 40 * j, f"/x{j}.html", agent=agent, signature=mark or ("-", "-"))) for j in range(5)]
    rows += [(90_000 + j, line("10.4.0.1", 90_000 + j, f"/r{j}", 301, agent="curl/8.0", host="e.org")) for j in range(60)]
    # rotated: the newer half has the smaller name
    rows.sort()
    half = len(rows) // 2
    (tmp_path / "a.log").write_text("".join(x + "\n" for _, x in rows[half:]))
    (tmp_path / "b.log").write_text("".join(x + "\n" for _, x in rows[:half]) + "broken\n")
    agents = spark.createDataFrame([(0, "search_engine", "Googlebot", ["googlebot.com"], None), (1, "ai_crawler", "GPTBot", None, [9])], "rank int, category string, token string, domains array<string>, asns array<bigint>")
    answers = spark.createDataFrame([("66.249.0.1", "c.googlebot.com.", False, ["66.249.0.1"]), ("66.249.0.2", "evil.test", False, ["66.249.0.2"])], "ip string, host string, no_record boolean, forward array<string>")
    run = census.analyze(
        spark, [str(tmp_path)], log_format=FORMAT, agents=agents, answers=answers, by_asn=spark.createDataFrame([(0, 7, "bird", "agent", "ai_crawler"), (1, 5, "cloud", "provider", None)], "rank int, asn bigint, name string, role string, category string"),
        as_db=bounds(spark, [(7, "Bird", "10.2.0.0/16"), (9, "Nine", "10.3.0.0/16"), (5, "Cloud", "10.5.0.0/16")], "asn bigint, as_org string, cidr string"),
        ranges=bounds(spark, [(1, "alpha", "10.4.0.0/16"), (0, "zeta", "10.4.0.0/24")], "rank int, name string, cidr string"),
        key_sets=spark.createDataFrame([(f'{{"keys":[{{"kty":"OKP","crv":"Ed25519","x":"{made._public(made.SEEDS[0])}"}}]}}',)], "jwks string"),
        operators=spark.createDataFrame([(0, "Signers", made._keyid(made.SEEDS[0]), None)], "rank int, operator string, keyid string, agent_url string"), robots_text="User-agent: *\nDisallow: /x3\n",
    )
    assert [s["file"].rsplit("/", 1)[1] for s in run.files] == ["a.log", "b.log"] and run.entries.orderBy("seq").first()["path"] == "/p0.html"
    assert (c := run.counters.first())["total"] == len(rows) + 1 and c["skipped"] == 1
    got = {r["client_ip"]: r for r in run.clients.collect()}
    kinds = {ip: got[ip]["kind"] for ip in ("10.0.0.1", "10.1.0.2", "66.249.0.1", "66.249.0.2", "bird", "10.3.0.0/24")}
    assert kinds == {"10.0.0.1": "browser", "10.1.0.2": "impersonator", "66.249.0.1": "search_engine", "66.249.0.2": "impersonator", "bird": "ai_crawler", "10.3.0.0/24": "ai_crawler"}
    tags = lambda ip: set(got[ip]["tags"])
    assert {"wba-verified"} <= tags("10.1.0.1") and got["10.1.0.1"]["signer"] == "Signers" and "wba-violation" in tags("10.1.0.2")
    assert "dns-verified" in tags("66.249.0.1") and "dns-violation" in tags("66.249.0.2") and "asn-associated" in tags("10.3.0.0/24")
    assert rollup.thresholds(run.clients).first()["pool"] >= 30 and "high-bytes" in tags("10.0.0.33") and "high-bytes" not in tags("10.0.0.1")
    assert {r["shadow"] for r in got.values()} == {"apex"} and "ignores-robots" in tags("10.1.0.1")
    nets = {ip: got[ip]["network"] for ip in got if ip.startswith("10.5") or ip.startswith("10.4")}
    assert nets == {"10.5.0.1": "cloud", "10.4.0.0/24": "zeta"} and got["66.249.0.1"]["network"] == "googlebot.com"
    kinds = {r["kind"]: r for r in run.kinds.collect()}
    assert kinds["search_engine"]["verified_clients"] == 1 and kinds["search_engine"]["verified_requests"] == 5 and kinds["impersonator"]["verified_clients"] == 0
    assert [(r["domain"], r["agent_token"], r["member_ips"], r["requests"]) for r in run.operators.collect()] == [("googlebot.com", "googlebot", ["66.249.0.1"], 5)]
    assert "| browser | 34 |" in census.markdown(run)
