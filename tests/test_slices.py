"""Flags set before or after the exchange of entries."""

from conftest import SF

from clientlens.operators import clients
from clientlens.plans import census, derived


def test_flags_after_the_exchange_are_those_before(spark):
    raw = clients.with_client(derived.log(spark, SF).where("seq < 300"))
    before, after = clients.ordered(census.flagged(raw), 3), clients.ordered(raw, 3)
    cols = [c for c in sorted(after.columns) if not c.startswith("_")]
    assert set(before.columns) == set(after.columns)
    rows = lambda d: sorted(map(str, d.select(*cols).collect()))
    assert rows(before) == rows(after)


def test_writing_slices_limits_methods_and_restores_the_setting(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    setting, seen, write = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    was = spark.conf.get(setting)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(setting)), write(self, path))[1])
    assert clients.in_slices(clients.with_client(derived.log(spark, SF).where("seq < 50")), 2).count() == 50
    assert seen == ["8000"] and spark.conf.get(setting) == was
