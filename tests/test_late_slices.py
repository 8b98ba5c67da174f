"""Co-load of clients whose time goes back where one slice ends."""

import datetime

from clientlens.operators import clients

START = datetime.datetime(2024, 1, 1)
# (seconds, path, referer) in order; "/o" is neither page nor asset
LATE = [(0, "/a.html", None), (50, "/o.json", None), (4, "/s.css", "/a.html"), (200, "/b.html", None), (20, "/c.html", None), (40, "/d.html", None), (60, "/o.json", None), (61, "/t.css", "/b.html")]


def test_slices_do_not_change_coload_of_late_entries(spark):
    rows = [("192.0.2.1", "x", i, START + datetime.timedelta(seconds=t), "GET", p, None, 200, 1, r and "https://e.org" + r, "x") for i, (t, p, r) in enumerate(LATE)]
    e = spark.createDataFrame(rows, "client_ip string, client_ua string, seq bigint, ts timestamp, method string, path string, query string, status int, bytes_sent bigint, referer string, user_agent string")
    e = e.withColumns({"remote_host": e.client_ip, "protocol": e.query})
    found = {n: [(r["pages_total"], r["pages_satisfied"]) for r in clients.coload_ordered(clients.ordered(e, n)).collect()] for n in (1, 2, 3, 8)}
    assert all(v == [(4, 1)] for v in found.values()), found
