"""Queries measure what they show, and no more."""

from conftest import SF

from clientlens.operators import clients
from clientlens.plans import census, derived, more, views


def _refuse(*_):
    raise AssertionError("measured what is not shown")


def test_identity_stats_writes_no_slices(spark, monkeypatch):
    monkeypatch.setattr(clients, "ordered", _refuse)
    row = more.identity_stats(spark, SF).first()
    log = derived.log(spark, SF)
    assert row["client_count"] == log.select("remote_host", "user_agent").distinct().count() and row["singletons"] >= 0


def test_crawl_delay_takes_gaps_only(spark, monkeypatch):
    monkeypatch.setattr(clients, "features", _refuse)
    assert views.crawl_delay(spark, SF).count() == derived.log(spark, SF).select("remote_host", "user_agent").distinct().count()


def test_different_values_repeat_no_entry(spark):
    plan = clients.features(clients.with_client(derived.log(spark, SF).where("seq < 300")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
