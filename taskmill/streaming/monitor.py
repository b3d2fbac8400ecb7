"""The state of runs from their events, as a stream and as a table. The definitions are our own.

An event has run, event_id, ts, kind, done, total. In the order of (ts, event_id), a run is

- running from its first `started`; what comes before that is ignored;
- paused by `paused`, running again by `resumed`;
- cancelled or finished by the first `cancelled` or `finished`; what comes after is ignored.

done is the most that a `progress` event tells, total the most that any tells (null if none). Active
time passes while the run is running, up to its last event that counts. The rest of a run
that isn't over takes eta_seconds = (total - done) / done * active_seconds, null where done is 0.
An event_id that comes again is the same event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

#: The state that each kind of event leads to.
LEADS_TO = {"started": "running", "paused": "paused", "resumed": "running", "cancelled": "cancelled", "finished": "finished"}
OVER = ("cancelled", "finished")
STATES = "run string, status string, started_at timestamp, last_at timestamp, done bigint, total bigint, active_seconds double, eta_seconds double"


def _eta(status, done, total, active):
    return F.when(~status.isin(*OVER) & (done > 0), F.greatest(total - done, F.lit(0)) / done * active)


def run_states(events: DataFrame) -> DataFrame:
    """STATES of a table of events, a row for each run that has started.

    Only events that change a state are ordered within a run; those that tell progress, which
    may be most of a run's, are aggregated before they are shuffled.
    """
    e = events.select(F.col("run").cast("string").alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"))
    e = e.filter(F.col("run").isNotNull() & F.col("ts").isNotNull())
    at = F.struct("ts", "event_id")
    over = F.col("kind").isin(*OVER)
    changes = e.filter(F.col("kind").isin(*LEADS_TO))
    whole = W.partitionBy("run")
    begun = changes.withColumn("begin", F.min(F.when(F.col("kind") == "started", at)).over(whole)).filter(F.col("begin").isNotNull() & (at >= F.col("begin")))
    lived = begun.withColumn("end", F.min(F.when(over, at)).over(whole)).filter(F.col("end").isNull() | (at <= F.col("end")))
    to = F.create_map(*[F.lit(x) for pair in LEADS_TO.items() for x in pair])
    spans = lived.dropDuplicates(["run", "event_id", "ts"]).withColumn("status", to[F.col("kind")]).withColumn("next", F.lead("ts").over(whole.orderBy("ts", "event_id")))
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    runs = spans.groupBy("run").agg(
        F.min("begin").alias("begin"), F.min("end").alias("end"), F.max_by("status", at).alias("status"), F.max("ts").alias("changed"),
        F.sum(F.when((F.col("status") == "running") & F.col("next").isNotNull(), F.unix_micros("next") - F.unix_micros("ts")).otherwise(0)).alias("micros"),
    )
    counted = e.join(runs.select("run", "begin", "end"), "run").filter((at >= F.col("begin")) & (F.col("end").isNull() | (at <= F.col("end"))))
    told = counted.groupBy("run").agg(F.coalesce(F.max(F.when(F.col("kind") == "progress", F.col("done"))), F.lit(0)).alias("done"), F.max("total").alias("total"), F.max("ts").alias("last_at"))
    active = F.col("micros") / 1e6 + F.when(F.col("status") == "running", seconds(F.col("changed"), F.col("last_at"))).otherwise(0.0)
    out = runs.join(told, "run").withColumn("active_seconds", active)
    return out.select("run", "status", F.col("begin.ts").alias("started_at"), "last_at", "done", "total", "active_seconds", _eta(F.col("status"), F.col("done"), F.col("total"), F.col("active_seconds")).alias("eta_seconds"))


class RunMonitor(StatefulProcessor):
    """Keeps what a run's events have led to, and those that the watermark hasn't passed.

    Events wait, by (ts, event_id), until the watermark passes them, so that they count in their
    order whatever the order they come in; each has a timer, which wakes the run then. One that
    comes again while it waits is the same entry, and one that is not behind the last that
    counted is late or repeated, and ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "micros bigint, event_id bigint", "kind string, done bigint, total bigint")
        self.now = handle.getValueState("now", "status string, started bigint, changed bigint, last bigint, last_id bigint, done bigint, total bigint, micros bigint, seen bigint, seen_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        passed = -1 if state is None else state["seen"], -1 if state is None else state["seen_id"]
        for frame in rows:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            for at, event, kind, done, total in zip(micros, frame["event_id"], frame["kind"], frame["done"], frame["total"], strict=True):
                if (at, event) > passed:
                    self.waiting.updateValue((int(at), int(event)), (kind, None if pd.isna(done) else int(done), None if pd.isna(total) else int(total)))
                    self.handle.registerTimer(-(-int(at) // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(k for k, _ in self.waiting.iterator() if k[0] <= reached)
        state = self._state() or {"status": None, "started": None, "changed": None, "last": None, "last_id": None, "done": 0, "total": None, "micros": 0, "seen": -1, "seen_id": -1}
        for at, event in due:
            kind, done, total = self.waiting.getValue((at, event))
            self.waiting.removeKey((at, event))
            state["seen"], state["seen_id"] = at, event
            step(state, at, kind, done, total)
        if not due:
            return
        self.now.update(tuple(state.values()))
        if state["status"] is not None:
            yield pd.DataFrame([shown(key[0], state)])

    def _state(self) -> dict | None:
        if not self.now.exists():
            return None
        names = ("status", "started", "changed", "last", "last_id", "done", "total", "micros", "seen", "seen_id")
        return dict(zip(names, self.now.get(), strict=True))

    def close(self) -> None:
        pass


def step(state: dict, at: int, kind: str, done: int | None, total: int | None) -> None:
    """One event, later than those before, changes the state."""
    if state["status"] in OVER or state["status"] is None and kind != "started":
        return
    if kind in LEADS_TO:
        if state["status"] is None:
            state["started"] = at
        elif state["status"] == "running":
            state["micros"] += at - state["changed"]
        state["status"], state["changed"] = LEADS_TO[kind], at
    elif kind == "progress" and done is not None:
        state["done"] = max(state["done"], done)
    state["last"] = at
    if total is not None:
        state["total"] = total if state["total"] is None else max(state["total"], total)


def shown(run: str, state: dict) -> dict:
    micros = state["micros"] + (state["last"] - state["changed"] if state["status"] == "running" else 0)
    over, done, total = state["status"] in OVER, state["done"], state["total"]
    eta = None if over or not done or total is None else max(total - done, 0) / done * (micros / 1e6)
    when = lambda x: pd.Timestamp(x, unit="us")
    return {"run": run, "status": state["status"], "started_at": when(state["started"]), "last_at": when(state["last"]), "done": done, "total": total, "active_seconds": micros / 1e6, "eta_seconds": eta}


def monitor(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """STATES of a stream of events: a row each time that the watermark has passed more of a run's
    events, the last of which is its row of run_states(). Events that are later than `late` are
    left out. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    e = events.select(F.col("run").cast("string").alias("run"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"))
    e = e.filter(F.col("run").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    return e.groupBy("run").transformWithStateInPandas(RunMonitor(), STATES, "Update", "EventTime")
