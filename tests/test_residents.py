"""Declared crawlers that can be checked stay single clients, however many they are."""

from clientlens.operators import clients, network
from clientlens.plans import census

BOT = "Googlebot/2.1"


def test_no_crawler_folds_for_being_one_of_many(spark, monkeypatch):
    first = network.residents
    monkeypatch.setattr(network, "residents", lambda entries, keys, most: first(entries, keys, min(most, 2)))  # a log with more than the cap of them
    rows = [(i, f"10.0.0.{i % 5}", BOT, "GET", f"/p{i}") for i in range(10)]
    e = spark.createDataFrame(rows, "seq bigint, remote_host string, user_agent string, method string, path string")
    own = spark.createDataFrame([("googlebot",)], "agent_token string")
    of = lambda **more: {r["client_ip"] for r in census.attributed(e, None, None, verifiable=own, **more).select(*clients.KEY).collect()}
    assert of() == {f"10.0.0.{k}" for k in range(5)}
    assert of(most_residents=2) == {"10.0.0.0", "10.0.0.1", "10.0.0.0/24"}
