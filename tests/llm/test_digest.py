"""The digest of an entity is made once a row."""

from clientlens.llm import pii


def test_surrogates_make_one_digest_a_row(spark, monkeypatch):
    plans, stored = [], pii.stored

    def seen(df, name):
        if name == "pii-made":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(pii, "stored", seen)
    e = spark.createDataFrame([("email", "ann@example.org"), ("given", "ann"), ("ip", "10.1.2.3")], "kind string, canon string")
    made = {r["kind"]: r["made"] for r in pii.surrogates(e).collect()}
    assert len(made) == 3 and made["ip"].startswith("10.")
    assert [p.count("sha2(") for p in plans] == [1] * len(plans)
