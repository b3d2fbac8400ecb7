import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from taskmill import plans
from taskmill.streaming import monitor as M
from taskmill.streaming import sessions as S

SF = "/root/testdata/sf0.001"
RUN_EVENTS = "run string, event_id long, ts timestamp, kind string, done long, total long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = datetime(2024, 1, 1)


def made_events(seed, runs=12, n=260):
    made = random.Random(seed)
    kinds = ["started", "paused", "resumed", "cancelled", "finished"] + ["progress"] * 6 + ["paused", "resumed", "other"]
    rows = []
    for i in range(n):
        kind = made.choice(kinds[:3] + kinds[5:]) if made.random() < 0.9 else made.choice(kinds)
        done = made.choice([None, made.randrange(90)]) if kind == "progress" else None
        rows.append((f"r{made.randrange(runs)}", i, T0 + timedelta(seconds=made.randrange(9000) // 7 * 7), kind, done, made.choice([None, 100])))
    return rows


def rounded(x):
    return None if x is None else round(x, 6)


def plain_states(rows):
    out = {}
    for run in {r[0] for r in rows}:
        state = {"status": None, "started": None, "changed": None, "last": None, "last_id": None, "done": 0, "total": None, "micros": 0}
        for _, _, ts, kind, done, total in sorted(set(r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            M.step(state, int((ts - T0).total_seconds() * 1e6), kind, done, total)
        if state["status"]:
            s = M.shown(run, state)
            out[run] = (s["status"], s["done"], s["total"], rounded(s["active_seconds"]), rounded(s["eta_seconds"]), state["last"])
    return out


def told(rows):
    return {r.run: (r.status, r.done, r.total, rounded(r.active_seconds), rounded(r.eta_seconds), int((r.last_at - T0).total_seconds() * 1e6)) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_of_a_table(spark, seed):
    rows = made_events(seed)
    df = spark.createDataFrame(rows + rows[::3] + [(None, 1, T0, "started", None, None), ("x", 2, None, "started", None, None)], RUN_EVENTS)
    assert told(M.run_states(df.repartition(3)).collect()) == plain_states(rows)
    assert M.run_states(df.limit(0)).count() == 0


def test_monitor_over_restarts(spark, tmp_path):
    """Late, repeated and unordered events, in files that a restarted stream goes on with: the last row of
    each run is the state of the table."""
    rows = made_events(7)
    order = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=random.Random(r[1]).randrange(500)), r[1]))
    waves = [order[i * len(order) // 5 : (i + 1) * len(order) // 5] for i in range(5)]
    last = max(r[2] for r in rows)
    seen = {}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        schema = spark.createDataFrame([], RUN_EVENTS).schema
        for i, wave in enumerate([*waves, [("end", 10_000, last + timedelta(hours=2), "started", None, None)], [("end", 10_001, last + timedelta(hours=2), "paused", None, None)]]):
            more = waves[i - 1][::4] if 0 < i < 5 else []  # again, a wave later
            spark.createDataFrame(wave + more, RUN_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = M.monitor(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "15 minutes")

            def keep(batch, _):
                for run, row in told(batch.collect()).items():
                    if run not in seen or row[5] >= seen[run][5]:
                        seen[run] = row

            q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start()
            q.awaitTermination(120)
            assert q.exception() is None
        # Behind the watermark: one that comes far too late changes nothing.
        assert {k: v for k, v in seen.items() if k != "end"} == plain_states(rows)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# ---------------------------------------------------------------- sessions and repeats


def plain_sessions(rows, gap):
    out = Counter()
    for key in {r[0] for r in rows}:
        times = sorted((t, v) for k, t, v in rows if k == key and t is not None)
        at = 0
        while at < len(times):
            end, n, total = times[at][0] + gap, 0, 0.0
            start = times[at][0]
            while at < len(times) and times[at][0] <= end:
                end, n, total, at = times[at][0] + gap, n + 1, total + times[at][1], at + 1
            out[key, start, end, n, round(total, 6)] += 1
    return out


def shape(rows):
    return Counter((r.user_id, r.session_start, r.session_end, r.n, round(r.total, 6)) for r in rows)


@pytest.mark.parametrize("part", [600, 86_400])
def test_sessions_of_a_table(spark, part):
    made = random.Random(4)
    rows = [(made.choice([1, 1, 1, 2, None]), T0 + timedelta(seconds=made.randrange(40_000) // 60 * 60), float(made.randrange(5))) for _ in range(500)]
    rows += [(3, T0 + timedelta(minutes=30 * i), 1.0) for i in range(40)]  # each exactly a gap apart
    df = spark.createDataFrame(rows + [(4, None, 1.0)], "user_id long, ts timestamp, value double").repartition(3)
    got = S.sessions(df, gap="30 minutes", part_seconds=part)
    assert shape(got.collect()) == plain_sessions(rows, timedelta(minutes=30))
    assert S.sessions(df.limit(0)).count() == 0


def test_stream_of_repeats_equals_the_table(spark, tmp_path):
    """Shuffled files of events that come again, in sessions: stream and table agree."""
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 400").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = [tuple(r) for r in events.collect()]
    made = random.Random(8)
    order = sorted(rows, key=lambda r: r[2] + timedelta(minutes=made.randrange(50)))
    folder = str(tmp_path / "in")
    for i in range(0, len(order), 100):
        spark.createDataFrame(order[i : i + 100] + order[max(0, i - 30) : i], events.schema).coalesce(1).write.mode("append").parquet(folder)
    far = (10**6, 0, max(r[2] for r in rows) + timedelta(days=9), 0.0)
    spark.createDataFrame([far], events.schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = S.sessions(S.without_repeats(source, late="2 hours"), gap="5 hours", late=None)
    q = out.writeStream.outputMode("append").format("memory").queryName("by_session").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = shape(spark.table("by_session").collect())
    table = spark.createDataFrame(order + order[::4], events.schema)
    want = shape(S.sessions(S.without_repeats(table), gap="5 hours").collect())
    assert got == want == plain_sessions([r[1:] for r in rows], timedelta(hours=5))


def test_repeats_of_a_table(spark):
    df = spark.createDataFrame([(1, T0, 1.0), (1, T0 - timedelta(1), 2.0), (None, T0, 3.0), (None, T0, 4.0), (2, T0, 5.0)], "event_id long, ts timestamp, value double")
    assert sorted((r.event_id or 0, r.value) for r in S.without_repeats(df).collect()) == [(0, 3.0), (1, 2.0), (2, 5.0)]


def test_run_events_cover_the_states(spark):
    states = {r.status for r in plans.queries()["ext_run_states"](spark, "/root/testdata/sf0.01").select("status").distinct().collect()}
    assert states == {"running", "paused", "finished"}
