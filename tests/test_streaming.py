"""Streams give what batches give, also for clients that come back."""

import datetime

from pyspark.sql import functions as F

from clientlens.plans import census, derived
from clientlens.streaming import clients as streaming


SCHEMA = "client_ip string, client_ua string, ts timestamp, bytes bigint, status int, probe boolean, path string"


def streamed(spark, folder, batches, **options):
    """Rows that a stream of files, one a batch, puts out; and rows of state after each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)
    try:
        for k, rows in enumerate(batches):
            (rows if hasattr(rows, "write") else spark.createDataFrame(rows, SCHEMA)).coalesce(1).write.parquet(f"{folder}/in/{k}")
            src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            seen: list = []
            q = streaming.running_clients(src, **options).writeStream.outputMode("update").foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option(
                "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            q.awaitTermination(240)
            yield seen, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_equals_batch(spark, tmp_path):
    e = census.flagged(derived.log(spark, "/root/testdata/sf0.001")).select("client_ip", "client_ua", "ts", "bytes", "status", "probe", "path")
    # the second half first: every row of the first half is late
    half = F.lit("2024-01-15").cast("timestamp")
    got: dict = {}
    for rows, _ in streamed(spark, tmp_path, [e.where(F.col("ts") >= half), e.where(F.col("ts") < half)], forget_hours=24 * 400):
        for r in rows:
            key = (r["client_ip"], r["client_ua"])
            got[key] = max(got.get(key, (0,)), (r["requests"], r["total_bytes"], r["not_found"], r["probes"], r["first_seen"], r["last_seen"]))
    micros = lambda f: f(F.unix_micros("ts") / 1e6)
    want = e.groupBy("client_ip", "client_ua").agg(F.count("*"), F.sum("bytes"), F.count_if(F.col("status") == 404), F.count_if("probe"), micros(F.min), micros(F.max)).collect()
    assert got == {(r[0], r[1]): tuple(r[2:]) for r in want}


def test_clients_come_back_and_are_forgotten(spark, tmp_path):
    at = lambda hour: datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=hour)
    row = lambda ip, hour, path="/": (ip, None, at(hour), 5, 404, path != "/", path)
    batches = [
        [row("a", 0, "/x"), row("b", 1), row("c", 0)],
        [row("b", 30)],  # a and c are quiet for a day
        [row("a", 31, "/y"), row("a", 2, "/x")],  # a returns, with a late row
        [row("b", 31 + 24 * 8)],  # all others are forgotten after a week
        [row("c", 31 + 24 * 8)],
    ]
    steps, state = [], []
    for rows, totals in streamed(spark, tmp_path, batches, forget_hours=24 * 7):
        steps.append({(r["client_ip"], r["state"]): (r["requests"], r["visits"], r["probe_paths"]) for r in rows})
        state.append(totals[-1])
    assert steps[0] == {("a", "active"): (1, 1, ["/x"]), ("b", "active"): (1, 1, []), ("c", "active"): (1, 1, [])}
    assert steps[1][("a", "dormant")] == (1, 1, ["/x"]) and steps[1][("c", "dormant")] == (1, 1, []) and steps[1][("b", "active")] == (2, 1, [])
    assert steps[2][("a", "active")] == (3, 2, ["/x", "/y"])
    assert steps[3][("a", "final")] == (3, 2, ["/x", "/y"]) and steps[3][("c", "final")] == (1, 1, [])
    assert steps[4][("c", "active")] == (1, 1, []) and state[3] < state[2]


def test_cadence(spark, tmp_path):
    e = derived.log(spark, "/root/testdata/sf0.001").select("ts", "status")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = streaming.cadence(src).writeStream.outputMode("complete").format("memory").queryName("grid").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.sql("select sum(requests) from grid").first()[0] == e.count()
