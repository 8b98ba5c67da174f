"""Log files: order, ends, headers and odd lines."""

import gzip
import json

from pyspark.sql import functions as F

from clientlens.functions.agents import agent_profile
from clientlens.sources import ends, logs

PARSE = lambda lines: logs.parse_apache(lines)


def line(day, hour=0, path="/", ok=True):
    return f'10.0.0.1 - - [{day:02d}/Oct/2023:{hour:02d}:00:00 +0000] "GET {path} HTTP/1.1" 200 5' if ok else "no entry"


def files(tmp_path):
    put = lambda name, lines: (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    put("access.log", [line(20, path="/new"), line(25)])
    put("access.log.2", [line(1, path="/old"), *[line(3, path="/" + "x" * 500)] * 400, *["noise" * 20] * 900])
    put("access.log.10", ["garbage"] * 3)
    put("empty.log", [])
    with gzip.open(tmp_path / "access.log.1.gz", "wt") as f:
        f.write(line(10, path="/mid") + "\n" + line(12) + "\n")
    return ends.list_files(__import__("pyspark").sql.SparkSession.getActiveSession(), [str(tmp_path)])


def names(order):
    return [f.rsplit("/", 1)[1] for f, _ in order]


def test_order_and_window(spark, tmp_path):
    given = files(tmp_path)
    order, start, spans = ends.order_logs(spark, given, PARSE)
    assert names(order) == ["access.log.10", "empty.log", "access.log.2", "access.log.1.gz", "access.log"] and start is None
    day = 86400.0
    keep = lambda seconds: names(ends.order_logs(spark, given, PARSE, seconds, from_latest=True)[0])
    assert keep(4 * day) == ["access.log.10", "empty.log", "access.log"]  # the .gz ends before day 20, where the next begins
    assert keep(6 * day) == ["access.log.10", "empty.log", "access.log.1.gz", "access.log"]
    assert keep(22 * day) == ["access.log.10", "empty.log", "access.log.2", "access.log.1.gz", "access.log"]
    got = {s["file"].rsplit("/", 1)[1]: s for s in ends.order_logs(spark, given, PARSE, 4 * day, from_latest=True)[2]}
    big = got["access.log.2"]
    assert big["last"] - big["first"] == 2 * day * 1e6 and big["size"] > 200_000
    assert got["access.log.1.gz"]["last"] is None and got["access.log.10"]["first"] is None
    # a year later nothing but what cannot be placed is left; the last .gz never goes
    assert names(ends.order_logs(spark, given, PARSE, day, now=1.8e9)[0]) == ["access.log.10", "empty.log"]


def test_only_the_ends_are_read(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(line(1 + k // 20_000, k % 24) + "\n" for k in range(100_000)))
    given = ends.list_files(spark, [f"{tmp_path}/big.log"])
    s = ends.order_logs(spark, given, PARSE, 86400.0, from_latest=True)[2][0]
    assert s["size"] > 6_000_000 and s["bytes_read"] < 130_000 and s["last"] > s["first"]


def test_folder_in_order_of_time(spark, tmp_path):
    order = ends.order_logs(spark, files(tmp_path), PARSE)[0]
    e = logs.read_log(spark, [str(tmp_path)], files=order).where("skip_reason is null").orderBy("seq").select("path", "ts").collect()
    assert [e[0]["path"], e[-2]["path"]] == ["/old", "/new"] and [r["ts"] for r in e] == sorted(r["ts"] for r in e)
    twice = logs.read_lines(spark, [f"{tmp_path}/access.log", f"{tmp_path}/access.log"])
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert twice.count() == 4 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_names_and_no_files(spark, tmp_path):
    (tmp_path / "a b+c%41.log").write_text(line(1) + "\n\n")
    assert logs.read_lines(spark, [str(tmp_path)]).count() == 1
    assert logs.read_lines(spark, [], files=[]).count() == 0


def test_signed_headers_and_surrogates(spark, tmp_path):
    records = [
        {"ClientIP": "1.2.3.4", "ClientRequestURI": "/p", "RequestHeaders": {"SIGNATURE-input": "sig1=()", "signature": "sig1=:AA==:", "Cookie": "x"}},
        {"ClientIP": "1.2.3.4", "ClientRequestURI": "/q", "RequestHeaders": 7, "ClientASN": 5},
    ]
    text = "\n".join(map(json.dumps, records)) + '\n{"ClientIP":"1.2.3.4","ClientRequestURI":"/a\\ud800b\\udc00c\\ud83d\\ude00"}\n'
    (tmp_path / "x.json").write_text(text)
    got = logs.read_log(spark, [f"{tmp_path}/x.json"], source="cloudflare").orderBy("seq").collect()
    assert got[0]["extra"] == {"Signature-Input": "sig1=()", "Signature": "sig1=:AA==:"} and got[1]["extra"] == {"asn": "5"}
    assert got[2]["path"] == "/a�b�c\U0001f600"


def test_other_directives(spark, tmp_path):
    (tmp_path / "y.log").write_text("10.0.0.1 443 17 - + proxy /srv/x 12 34 46 8443\n")
    e = logs.read_log(spark, [f"{tmp_path}/y.log"], "%h %p %P %k %X %R %f %I %O %S %{remote}p").first()
    assert e["skip_reason"] is None and e["extra"] == {
        "port": "443", "pid": "17", "conn_status": "+", "handler": "proxy", "filename": "/srv/x", "bytes_in": "12", "bytes_out": "34", "bytes_total": "46", "port:remote": "8443",
    }


def test_first_token_of_each_category(spark):
    uas = spark.createDataFrame([("Alphabot betabot",), ("betabot",), ("nobody",), (None,), ("gammabot BETABOT",)], "user_agent string")
    table = spark.createDataFrame([(1, "x", "betabot"), (0, "y", "alphabot"), (2, "x", "gammabot")], "rank int, category string, token string")
    got = {r["user_agent"]: (r["agent_category"], r["agent_token"], r["category_tokens"]) for r in agent_profile(uas, table).collect()}
    assert got["Alphabot betabot"] == ("y", "alphabot", {"y": "alphabot", "x": "betabot"}) and got["gammabot BETABOT"] == ("x", "betabot", {"x": "betabot"})
    assert got["nobody"][:2] == (None, None) and got[None][:2] == (None, None)
    plan = agent_profile(uas, table).where(F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
