"""Running totals of clients, and requests on a time grid, over streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = "requests bigint, total_bytes bigint, not_found bigint, probes bigint, first_seen double, last_seen double, visits bigint"
OUT = f"client_ip string, client_ua string, {FIELDS}, probe_paths array<string>, state string"
HOUR_MS = 3_600_000
SAMPLES = 5
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Clients(StatefulProcessor):
    """Totals of one client: a value state, the first few probed paths in a list
    state, and one timer, set by event time.

    After ``quiet_ms`` without a request the client is parked: its totals are
    reported as dormant and stay.  A request, also a late one, is merged into them.
    After ``forget_ms`` the totals are reported a last time and the state is freed;
    a client that comes back even later begins a new row of totals.
    """

    def __init__(self, quiet_ms: int, forget_ms: int, late_ms: int):
        self.quiet_ms, self.forget_ms, self.late_ms = quiet_ms, forget_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", f"{FIELDS}, parked boolean")
        self.paths = handle.getListState("probe_paths", "path string")

    def _row(self, key, totals, state: str) -> pd.DataFrame:
        paths = [p[0] for p in self.paths.get()]
        return pd.DataFrame([(*key, *totals, paths, state)], columns=[c.split()[0] for c in OUT.split(", ")])

    def _wake(self, at_ms: float, timers) -> None:
        """One timer: when the newest event of all is at ``at_ms``.  The watermark
        stays ``late_ms`` behind that, so that late rows still get here."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(at_ms) - self.late_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues):
        old = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, float("inf"), float("-inf"), 0, True)
        n, size, missing, probes, first, last, visits, parked = old
        for b in rows:
            n, size = n + len(b), size + int(b["bytes"].sum())
            missing, probes = missing + int((b["status"] == 404).sum()), probes + int(b["probe"].sum())
            first, last = min(first, float(b["t"].min())), max(last, float(b["t"].max()))
            known = [p[0] for p in self.paths.get()]
            for p in b.loc[b["probe"], "path"]:
                if len(known) < SAMPLES and p not in known:
                    known.append(p)
                    self.paths.appendValue((p,))
        totals = (n, size, missing, probes, first, last, visits + bool(parked))
        self.totals.update((*totals, False))
        self._wake(last * 1000 + self.quiet_ms, timerValues)
        yield self._row(key, totals, "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        *totals, parked = self.totals.get()
        forget = totals[5] * 1000 + self.forget_ms
        if parked or timerValues.getCurrentWatermarkInMs() >= forget - self.late_ms:
            yield self._row(key, totals, "final")
            self.totals.clear()
            self.paths.clear()
            return
        self.totals.update((*totals, True))
        yield self._row(key, totals, "dormant")
        self._wake(forget, timerValues)


def running_clients(flagged: DataFrame, quiet_hours: float = 24, forget_hours: float = 24 * 30, late_days: int = 3650) -> DataFrame:
    """A row per client and batch with its totals so far, one when it falls
    quiet (``dormant``) and one when it is forgotten (``final``).

    Time is that of events: the newest one seen decides what is quiet.  Rows of any
    lateness up to ``late_days`` are counted, where they arrive; entries without a time
    are left out.  The session's state store must be RocksDB (``ROCKSDB``).
    """
    late_ms = late_days * 24 * HOUR_MS
    processor = Clients(int(quiet_hours * HOUR_MS), int(forget_hours * HOUR_MS), late_ms)
    e = flagged.where("ts is not null").select("client_ip", "client_ua", "ts", "bytes", "status", "probe", "path", (F.unix_micros("ts") / 1e6).alias("t"))
    e = e.withWatermark("ts", f"{late_days} days")
    return e.groupBy("client_ip", "client_ua").transformWithStateInPandas(processor, OUT, "update", "eventTime")


def cadence(entries: DataFrame, grid: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Requests on a time grid, by status class, closed once the watermark passes."""
    w = F.window("ts", grid)
    return entries.withWatermark("ts", late).groupBy(w, F.floor(F.col("status") / 100).alias("status_class")).agg(F.count(F.lit(1)).alias("requests")).select(
        F.col("window.start").alias("slot"), "status_class", "requests"
    )
