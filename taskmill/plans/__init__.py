"""Queries over the test tables, each with SQL of the same rows.

Names follow the operators; ext_ marks what goes beyond them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill import functions as X
from taskmill import operators as O
from taskmill import sources as S
from taskmill import streaming, tables
from taskmill.sources import json_array

_all: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _all[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def tasks(df: DataFrame, key: str, flag=None) -> DataFrame:
    """A task relation of any table: its key column, and a flag expression."""
    return df.select(X.key_or_unknown(F.col(key)).alias("db_key"), (F.lit(False) if flag is None else flag).alias("has_colloquial"))


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS db_key, count(*) AS n FROM documents GROUP BY 1")
def group_count(spark, d):
    return O.group_count(tasks(table(spark, d, "documents"), "lang"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS db_key FROM documents")
def key_default(spark, d):
    return table(spark, d, "documents").select("doc_id", X.key_or_unknown(F.col("lang")).alias("db_key"))


@query("SELECT coalesce(nullif(quality::VARCHAR, ''), 'unknown') AS db_key, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def key_default_null(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return O.group_count(tasks(both, "quality"))


@query("SELECT coalesce(sum(CASE WHEN quality <> 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n FROM labels")
def truthy_count(spark, d):
    return table(spark, d, "labels").agg(F.count_if(X.truthy_number(F.col("quality"))).alias("n"))


@query("SELECT count(DISTINCT source) AS n_keys, string_agg(DISTINCT source, ',' ORDER BY source) AS keys FROM documents")
def sorted_distinct(spark, d):
    one = O.summarise(tasks(table(spark, d, "documents"), "source"))
    return one.select(F.col("database_count").alias("n_keys"), F.array_join("databases", ",").alias("keys"))


@query("SELECT count(*) > 0 AND min(n) = 5 AND max(n) = 5 AS uniform FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def uniform_groups_true(spark, d):
    return O.is_uniform(O.group_count(table(spark, d, "nation"), "n_regionkey"), 5)


@query("SELECT count(*) > 0 AND min(n) = 2 AND max(n) = 2 AS uniform FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def uniform_groups_false(spark, d):
    return O.is_uniform(O.group_count(table(spark, d, "conversations"), "conv_id"), 2)


@query("""SELECT sum(n)::BIGINT AS task_count, count(*) AS database_count, sum(f)::BIGINT AS robustness_task_count, min(n) = 110 AND max(n) = 110 AS balanced_110
FROM (SELECT source, count(*) AS n, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS f FROM documents GROUP BY 1)""")
def dataset_summary(spark, d):
    one = O.summarise(tasks(table(spark, d, "documents"), "source", X.truthy_text(F.col("text"))))
    return one.select("task_count", "database_count", "robustness_task_count", "balanced_110")


@query("SELECT ((SELECT count(*) FROM events) * (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark))::BIGINT AS planned_tasks")
def planned_workload(spark, d):
    return O.planned_workload(table(spark, d, "events"), table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("SELECT 10 * 2 * count(*) AS planned_tasks FROM documents")
def planned_workload_all(spark, d):
    return O.planned_workload(S.methods(spark), S.tracks(spark), table(spark, d, "documents"))


@query("SELECT count(DISTINCT event_type) AS database_count, count(*) AS collection_count FROM events WHERE event_type NOT IN ('click', 'view')")
def exclusion_filter(spark, d):
    return O.inventory_summary(table(spark, d, "events").select(F.col("event_type").alias("db"), F.col("event_id").cast("string").alias("collection")), ("click", "view")).select("database_count", "collection_count")


@query("SELECT event_id, coalesce(substr(event_type, 1, 3), 'Not connected') AS short FROM events")
def prefix_slice(spark, d):
    return table(spark, d, "events").select("event_id", X.short_commit(F.col("event_type"), 3).alias("short"))


@query("SELECT doc_id, CASE WHEN quality <> 0 AND toxic <> 0 AND (SELECT count(*) > 0 FROM benchmark) THEN 'ready' ELSE 'degraded' END AS status FROM labels")
def readiness(spark, d):
    there = table(spark, d, "benchmark").agg((F.count(F.lit(1)) > 0).alias("there"))
    flags = table(spark, d, "labels").crossJoin(there)  # one row
    return flags.select("doc_id", X.is_ready(X.truthy_number(F.col("quality")), X.truthy_number(F.col("toxic")), F.col("there")).alias("status"))


@query("SELECT list(n_name ORDER BY n_nationkey) = list(n_name ORDER BY n_name DESC) AS matches FROM nation")
def sequence_equality(spark, d):
    n = table(spark, d, "nation")
    last = n.select((-F.col("n_nationkey")).alias("ord"), F.col("n_name").alias("id"))
    return O.matches_in_order(n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id")), last)


@query("SELECT event_id, (props->>'$.k') AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, (props->>'$.k') AS k FROM events")
def json_variant(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@query("SELECT doc_id AS ord, source AS id FROM documents WHERE source = 'src1'")
def filter_project(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("id"), F.col("source").alias("family"))
    return O.ids_of_family(m, "src1")


@query("SELECT count(*) AS collection_count FROM nation")
def sum_of_counts(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("db"), F.col("n_name").alias("collection"))
    return O.inventory_summary(n).select("collection_count")


@query("SELECT source AS db_key, count(*) AS n FROM documents GROUP BY 1")
def group_count_sorted(spark, d):
    return O.group_count(tasks(table(spark, d, "documents"), "source")).orderBy("db_key")


@query("SELECT DISTINCT event_type AS db FROM events")
def distinct_names(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("db")).distinct().orderBy("db")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'EUROPE' WHEN 'EUROPE' THEN 'ASIA' ELSE 'ASIA,EUROPE,' || r_name END AS picked FROM region")
def toggle(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.array_join(X.toggled(F.array(F.lit("ASIA"), F.lit("EUROPE")), F.col("r_name")), ",").alias("picked"))


@query("SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_custkey': o_custkey})::VARCHAR AS json FROM orders")
def json_sink(spark, d):
    return O.as_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))


@query("""SELECT to_json({'task_count': count(*), 'by_key': (SELECT list({'db_key': l, 'n': n} ORDER BY l) FROM (SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1))})::VARCHAR AS json FROM documents""")
def json_document(spark, d):
    one = O.group_count(tasks(table(spark, d, "documents"), "lang")).agg(F.sum("n").alias("task_count"), F.array_sort(F.collect_list(F.struct("db_key", "n"))).alias("by_key"))
    return O.as_json(one)


@query("SELECT conv_id, len(list(turn))::INT AS turns FROM conversations GROUP BY 1")
def list_length(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return turns.select("conv_id", X.list_length(F.col("turns")).alias("turns"))


@query("SELECT row_number() OVER (ORDER BY source) AS place, source AS db_key, count(*) AS n FROM documents GROUP BY source")
def sorted_count_map(spark, d):
    """Keys in order with their places, from the entries of the summary."""
    one = O.summarise(tasks(table(spark, d, "documents"), "source"))
    return one.select(F.posexplode("tasks_per_database").alias("place", "db_key", "n")).withColumn("place", F.col("place").cast("long") + 1)


@query("SELECT o_orderkey, format('{:,}', o_custkey) AS shown FROM orders")
def thousands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.thousands(F.col("o_custkey")).alias("shown"))


@query("SELECT doc_id, CASE WHEN lang = 'sag' THEN 'SAG' ELSE 'BASE' END AS label FROM documents")
def label_case(spark, d):
    return table(spark, d, "documents").select("doc_id", X.family_label(F.col("lang")).alias("label"))


@query("SELECT o_orderstatus AS method, o_orderpriority AS track, count(*) AS n, avg(o_totalprice) AS avg_o_totalprice FROM orders GROUP BY 1, 2")
def ext_result_rollup(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "method", "o_orderpriority": "track"})
    return O.result_rollup(o, ("method", "track"), ("o_totalprice",))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def ext_progress(spark, d):
    return streaming.progress(table(spark, d, "events"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY 1")
def ext_outcome_table(spark, d):
    return O.outcome_table(table(spark, d, "documents"), "source", "lang", ["en", "de"])


@query("SELECT n_name AS id, unnest(range(1, CASE WHEN n_regionkey = 1 THEN 4 ELSE 2 END))::INT AS sample FROM nation")
def ext_self_consistency(spark, d):
    m = table(spark, d, "nation").select(F.col("n_name").alias("id"), (F.col("n_regionkey") == 1).alias("supports_self_consistency"))
    return O.self_consistency_runs(m, 3)


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS db_key, count(*) AS n, count(*) FILTER (text <> '') AS flags FROM documents GROUP BY 1")
def json_array_scan(spark, d):
    """Documents as files of one JSON array each, read back by the strict reader in ranges."""
    folder = tables.new_path(spark, "task-files")
    json_array.write_arrays(table(spark, d, "documents").select(F.col("source").alias("db_id"), F.col("text").alias("NLQ_colloquial")), folder)
    tasks = S.read_task_files(spark, folder)
    # An error would show as a key that the table doesn't have.
    return tasks.groupBy(F.coalesce("db_key", "error").alias("db_key")).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_colloquial").alias("flags"))


# Fixed choice of this query: which event of the table stands for which event of a run.
_RUN_KINDS = {"signup": "started", "view": "progress", "error": "paused", "click": "resumed", "purchase": "finished"}


def run_events(events: DataFrame) -> DataFrame:
    """The table's events as those of runs: a run for each user and day, done as props tells, of 120."""
    kind = F.create_map(*[F.lit(x) for pair in _RUN_KINDS.items() for x in pair])[F.col("event_type")]
    done = F.get_json_object("props", "$.k").cast("long")
    run = F.concat_ws("-", F.pmod("user_id", F.lit(40)).cast("string"), F.date_format("ts", "dd"))
    return events.select(run.alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(kind == "progress", done).alias("done"), F.lit(120).cast("long").alias("total"))


@query("""WITH e AS (SELECT (user_id % 40)::VARCHAR || '-' || strftime(ts, '%d') AS run, event_id, ts, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'error' THEN 'paused' WHEN 'click' THEN 'resumed' ELSE 'finished' END AS kind, CASE WHEN event_type = 'view' THEN (props->>'$.k')::BIGINT END AS done FROM events),
b AS (SELECT *, min(ts) FILTER (kind = 'started') OVER (PARTITION BY run) AS begun FROM e),
f AS (SELECT *, min(ts) FILTER (kind = 'finished') OVER (PARTITION BY run) AS over FROM b WHERE ts >= begun),
l AS (SELECT * FROM f WHERE over IS NULL OR ts <= over),
c AS (SELECT *, lead(ts) OVER (PARTITION BY run ORDER BY ts, event_id) AS next, last_value(CASE kind WHEN 'started' THEN 'running' WHEN 'resumed' THEN 'running' WHEN 'paused' THEN 'paused' WHEN 'finished' THEN 'finished' END IGNORE NULLS) OVER (PARTITION BY run ORDER BY ts, event_id) AS state FROM l),
g AS (SELECT run, arg_max(state, ts) AS status, min(ts) AS started_at, max(ts) AS last_at, coalesce(max(done), 0) AS done, coalesce(sum(CASE WHEN state = 'running' THEN epoch_us(next) - epoch_us(ts) END), 0)::BIGINT AS micros FROM c GROUP BY run)
SELECT run, status, epoch_us(started_at) AS started_at, epoch_us(last_at) AS last_at, done, 120::BIGINT AS total, micros / 1e6::DOUBLE AS active_seconds, CASE WHEN status <> 'finished' AND done > 0 THEN greatest(120 - done, 0)::DOUBLE / done * (micros / 1e6::DOUBLE) END AS eta_seconds FROM g""")
def ext_run_states(spark, d):
    """Final states of runs, one for each user group and day."""
    from taskmill.streaming.monitor import run_states

    out = run_states(run_events(table(spark, d, "events")))
    return out.withColumns({c: F.unix_micros(c) for c in ("started_at", "last_at")})


@query("""WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 36 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 36 HOUR AS session_end, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, number""")
def ext_sessions(spark, d):
    """Sessions of users, of events that come in twice, the second time a little later."""
    from taskmill.streaming import sessions as by_gap

    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    again = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 SECONDS"))
    return by_gap.sessions(by_gap.without_repeats(e.unionByName(again)), gap="36 hours")


@query("""WITH l AS (SELECT event_id, user_id % 7 AS who, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS commit_id, user_id % 7 AS who, date_trunc('hour', ts) AS ts, value FROM events WHERE event_type IN ('signup', 'error')),
o AS (SELECT who, ts, max({'value': value, 'id': commit_id}) AS best FROM r GROUP BY 1, 2)
SELECT l.event_id, o.best.id AS commit_id, o.best.value AS commit_value FROM l ASOF LEFT JOIN o ON l.who = o.who AND l.ts >= o.ts""")
def ext_as_of(spark, d):
    """Which commit each result was made by: the last one of the same group as of the result's time."""
    from taskmill.operators.temporal import as_of

    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", (F.col("user_id") % 7).alias("who"), "ts")
    right = e.filter("event_type IN ('signup', 'error')").select((F.col("user_id") % 7).alias("who"), F.date_trunc("hour", "ts").alias("ts"), "value", F.col("event_id").alias("commit_id"))
    return as_of(left, right, "who", "ts").select("event_id", "found.commit_id", F.col("found.value").alias("commit_value"))


@query("""WITH s AS (SELECT event_id AS run_id, user_id % 40 AS host, ts AS a, ts + to_seconds((value * value)::BIGINT) AS b FROM events WHERE event_type <> 'error'),
w AS (SELECT event_id AS window_id, user_id % 40 AS host, ts AS c, ts + to_seconds(power(1.13, (props->>'$.k')::DOUBLE)::BIGINT) AS d FROM events WHERE event_type = 'error')
SELECT run_id, window_id, (epoch_us(least(b, d)) - epoch_us(greatest(a, c))) // 1000000 AS seconds FROM s JOIN w ON s.host = w.host AND a < b AND c < d AND a < d AND c < b""")
def ext_interval_join(spark, d):
    """Runs and the windows in which their host was unavailable, seconds to days long."""
    from taskmill.operators.temporal import interval_join

    e = table(spark, d, "events").withColumn("host", F.col("user_id") % 40).withColumn("ts", F.col("ts").cast("timestamp"))
    later = lambda seconds: F.timestamp_micros(F.unix_micros("ts") + F.rint(seconds).cast("long") * 1_000_000)
    runs = e.filter("event_type <> 'error'").select(F.col("event_id").alias("run_id"), "host", F.col("ts").alias("a"), later(F.col("value") * F.col("value")).alias("b"))
    down = e.filter("event_type = 'error'").select(F.col("event_id").alias("window_id"), "host", F.col("ts").alias("c"), later(F.pow(F.lit(1.13), F.get_json_object("props", "$.k").cast("double"))).alias("d"))
    both = interval_join(runs, down, "host", ("a", "b"), ("c", "d"))
    micros = F.unix_micros(F.least("a.b", "b.d")) - F.unix_micros(F.greatest("a.a", "b.c"))
    return both.select("a.run_id", "b.window_id", F.floor(micros / 1_000_000).alias("seconds"))


_FOLD = "list_reduce(list_prepend(0::BIGINT, list_reverse(h)), lambda d, x: (d * {base} + x) % {p})"


def _digest_sql() -> str:
    from taskmill.operators.sequences import MODULI

    folds = ", ".join(_FOLD.format(p=p, base=base) + f" AS d{i}" for i, (p, base) in enumerate(MODULI, 1))
    return f"""WITH s AS (SELECT event_type, list(('0x' || substr(md5(user_id::VARCHAR), 1, 7))::BIGINT + 1 ORDER BY ts, user_id) AS h FROM events GROUP BY 1)
SELECT event_type, len(h)::BIGINT AS n, {folds} FROM s"""


@query(_digest_sql())
def ext_sequence_digest(spark, d):
    """Digests of the users of each kind of event, in the order of time."""
    from taskmill.operators.sequences import sequence_digests

    e = table(spark, d, "events").select("event_type", F.col("ts").alias("ord"), F.col("user_id").cast("string").alias("id"))
    return sequence_digests(e, ["event_type"])


@query("SELECT list(user_id ORDER BY ts, user_id::VARCHAR) = list(user_id ORDER BY event_id, user_id::VARCHAR) AS matches FROM events")
def ext_same_order(spark, d):
    """Whether events come in the order of their ids: two sequences of the whole table."""
    from taskmill.operators.sequences import same_order

    e = table(spark, d, "events").withColumn("id", F.col("user_id").cast("string"))
    return same_order(e.select(F.col("ts").alias("ord"), "id"), e.select(F.timestamp_micros("event_id").cast("timestamp_ntz").alias("ord"), "id"))


def _bootstrap_sql(replicates: int = 64) -> str:
    from taskmill.operators.statistics import POISSON

    weight = " + ".join(f"(u >= {p})::INT" for p in POISSON)
    return f"""WITH r AS (SELECT o_orderpriority AS method, o_custkey AS task, o_totalprice AS score, unnest(range(0, {replicates})) AS i FROM orders),
u AS (SELECT *, ('0x' || substr(md5('0:' || (i // 8)::VARCHAR || ':' || task::VARCHAR), (4 * (i % 8) + 1)::INT, 4))::BIGINT AS u FROM r),
w AS (SELECT method, i + 1 AS b, score, {weight} AS w FROM u UNION ALL SELECT o_orderpriority, 0, o_totalprice, 1 FROM orders),
m AS (SELECT method, b, sum(w) AS w, sum(w * score) / sum(w) AS mean FROM w WHERE w > 0 GROUP BY 1, 2),
d AS (SELECT m.*, m.mean - n.mean AS diff FROM m LEFT JOIN m n ON n.b = m.b AND n.method = '1-URGENT')
SELECT method, max(w) FILTER (b = 0)::BIGINT AS n, round(max(mean) FILTER (b = 0), 4) AS mean, round(quantile_cont(mean, 0.025) FILTER (b > 0), 4) AS low, round(quantile_cont(mean, 0.975) FILTER (b > 0), 4) AS high,
    round(max(diff) FILTER (b = 0), 4) AS diff, round(quantile_cont(diff, 0.025) FILTER (b > 0), 4) AS diff_low, round(quantile_cont(diff, 0.975) FILTER (b > 0), 4) AS diff_high FROM d GROUP BY method"""


@query(_bootstrap_sql())
def ext_bootstrap(spark, d):
    """Mean prices of orders by priority with intervals, and their differences to the first one's."""
    from taskmill.operators.statistics import bootstrap

    o = table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "method", "o_custkey": "task", "o_totalprice": "score"})
    out = bootstrap(o, baseline="1-URGENT")
    return out.select("method", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query("""WITH o AS (SELECT o_orderstatus AS method, nullif(o_orderpriority, '5-LOW') AS track, o_custkey % 3 AS db, o_totalprice AS score FROM orders)
SELECT method, track, db, grouping_id(method, track, db)::INT AS level, count(*) AS n, round(avg(score), 4) AS avg_score FROM o GROUP BY CUBE (method, track, db)""")
def ext_report(spark, d):
    """Results by method, track and database with all subtotals; a track that is null is no total."""
    from taskmill.operators.statistics import report

    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("method"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("track"), (F.col("o_custkey") % 3).alias("db"), F.col("o_totalprice").alias("score"))
    out = report(o, ("method", "track", "db"), ("score",))
    return out.withColumn("avg_score", F.round("avg_score", 4))


@query("SELECT event_type, count(*) AS n, true AS distinct_within, true AS median_within FROM events GROUP BY 1")
def ext_merged_sketches(spark, d):
    """Users and median values by kind of event, from sketches stored by kind and day, held against
    exact figures: whether each is within its sketch's bound."""
    from taskmill.operators import statistics as Q

    e = table(spark, d, "events")
    days = tables.written(Q.sketches(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value"), "sketches")
    told = Q.estimates(Q.merged(days, ["event_type"]), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(F.lit(0.5 - Q.RANK_ERROR), F.lit(0.5 + Q.RANK_ERROR))).alias("around"))
    within = told.join(exact, "event_type").withColumn("median", F.col("quantiles")[0])
    return within.select("event_type", "n", (F.abs(F.col("distinct") - F.col("users")) <= F.ceil(F.col("users") * Q.DISTINCT_ERROR)).alias("distinct_within"), F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_within"))


@query("""WITH old AS (SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS doc_id, text, lang, source FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END AS text, CASE WHEN doc_id % 14 = 0 THEN NULL ELSE lang END AS lang, source FROM documents WHERE doc_id % 10 <> 2
    UNION ALL SELECT doc_id, text, lang, source FROM documents WHERE doc_id % 11 = 3 AND doc_id % 7 <> 0 AND doc_id % 10 <> 2 AND doc_id % 50 <> 0),
r AS (SELECT doc_id, text, lang, source, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n FROM (SELECT *, 1 AS o, 0 AS n FROM old UNION ALL SELECT *, 0, 1 FROM new) GROUP BY ALL)
SELECT doc_id, sum(o)::BIGINT AS n_old, sum(n)::BIGINT AS n_new, CASE WHEN sum(o) = 0 THEN 'added' WHEN sum(n) = 0 THEN 'removed' WHEN bool_and(o = n) THEN 'same' WHEN bool_and(o > 0 AND n > 0) THEN 'repeated' ELSE 'changed' END AS change,
    CASE WHEN sum(o) = 1 AND sum(n) = 1 AND NOT bool_and(o = n) THEN concat_ws(',', CASE WHEN count(DISTINCT text) > 1 THEN 'text' END, CASE WHEN count(DISTINCT coalesce(lang, '?')) > 1 THEN 'lang' END) END AS fields FROM r GROUP BY doc_id""")
def ext_release_diff(spark, d):
    """Two releases of documents: some left out, changed or repeated, some without a key."""
    from taskmill.operators.releases import release_diff

    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    key = F.when(i % 50 != 0, i)
    old = docs.filter(i % 10 != 1).withColumn("doc_id", key)
    new = docs.filter(i % 10 != 2).select(key.alias("doc_id"), F.when(i % 7 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"), F.when(i % 14 != 0, F.col("lang")).alias("lang"), "source")
    again = docs.filter((i % 11 == 3) & (i % 7 != 0) & (i % 10 != 2) & (i % 50 != 0))
    return release_diff(old, new.unionByName(again), "doc_id").withColumn("fields", F.array_join("fields", ","))


@query("""SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error') AND ((props->>'$.k')::BIGINT BETWEEN 20 AND 39 OR value > 60 OR NOT (value > 1))
    AND NOT ((props->>'$.k')::BIGINT IN (21, 23, 25) OR event_type = 'error' AND user_id < 100)""")
def ext_document_query(spark, d):
    """Events that a user's filter asks for, by columns and by a field of their JSON."""
    from taskmill.operators.filters import matching

    asked = {"event_type": {"$in": ["click", "view", "error"]}, "$or": [{"k": {"$gte": 20, "$lt": 40}}, {"value": {"$gt": 60}}, {"value": {"$not": {"$gt": 1}}}], "$nor": [{"k": {"$in": [21, 23, 25]}}, {"event_type": "error", "user_id": {"$lt": 100}}], "k.x": {"$exists": False}}
    return matching(table(spark, d, "events"), asked, "props").select("event_id")


def _literals(names: str, rows) -> str:
    """SELECT of rows of values, in DuckDB's SQL."""
    shown = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


@query(f"""WITH m AS ({_literals("ord, id, title, family, description, supports_self_consistency", [(i, *r) for i, r in enumerate(S.METHOD_ROWS)])})
SELECT m.*, (SELECT count(*) FROM documents) AS planned FROM m""")
def method_relation(spark, d):
    """All methods, each with the tasks of one track."""
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("planned"))
    return S.methods(spark).crossJoin(n)  # one row


@query(f"""WITH t AS ({_literals("ord, id, field, title, description", [(i, *r) for i, r in enumerate(S.TRACK_ROWS)])})
SELECT t.*, (SELECT count(*) FROM labels WHERE CASE t.id WHEN 'canonical' THEN true ELSE quality <> 0 END) AS eligible FROM t""")
def track_relation(spark, d):
    """Both tracks, each with the labelled documents that it can ask: all, or those whose flag is set."""
    n = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("every"), F.count_if(X.truthy_number(F.col("quality"))).alias("flagged"))
    return S.tracks(spark).crossJoin(n).withColumn("eligible", F.when(F.col("id") == "canonical", F.col("every")).otherwise(F.col("flagged"))).drop("every", "flagged")  # one row


@query("""SELECT doc_id, CASE WHEN quality <> 0 AND toxic = 0 THEN 'System ready' ELSE 'Checking system' END AS status, CASE WHEN toxic <> 0 THEN 'Available' ELSE 'Unavailable' END AS availability, CASE WHEN quality = 0 THEN 'SAG' ELSE 'BASE' END AS family
FROM documents LEFT JOIN labels USING (doc_id)""")
def status_labels(spark, d):
    """Labels of status, availability and family; what isn't known is neither ready nor available."""
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    toxic = X.truthy_number(F.col("toxic"))
    status = X.is_ready(X.truthy_number(F.col("quality")), ~toxic)
    family = F.when(F.col("quality") == 0, F.lit("sag")).otherwise(F.lit("baseline"))
    return both.select("doc_id", X.status_label(status).alias("status"), X.availability_label(toxic).alias("availability"), X.family_label(family).alias("family"))


def _documents(spark, d, folder):
    """Documents of the catalogue over a task file that is made of the table of labels."""
    labels = table(spark, d, "labels").select((F.col("doc_id") % 11).cast("string").alias("db_id"), F.when(F.col("quality") == 1, "q").alias("NLQ_colloquial"))
    json_array.write_arrays(labels.coalesce(1), folder)  # the document is of one file
    (name,) = [r[0] for r in spark.read.format("binaryFile").load(folder).select("path").collect()]
    return name


@query("""WITH t AS (SELECT (doc_id % 11)::VARCHAR AS k, count(*) AS n, count(*) FILTER (quality = 1) AS f FROM labels GROUP BY 1)
SELECT 10 AS methods, 9 AS baselines, 2 AS tracks, sum(n)::BIGINT AS task_count, count(*) AS database_count, string_agg(k, ',' ORDER BY k) AS databases, sum(f)::BIGINT AS robustness_task_count, min(n) = 110 AND max(n) = 110 AS balanced_110, false AS upstream, true AS matches FROM t""")
def catalogue_document(spark, d):
    """The catalogue document of a task file, told column by column."""
    path = _documents(spark, d, tables.new_path(spark, "catalogue"))
    doc = O.catalogue(spark, path, official=O.ids_of_family(S.methods(spark)))
    return doc.select(
        F.size("methods").alias("methods"), F.size(F.filter("methods", lambda m: m["family"] == "baseline")).alias("baselines"), F.size("tracks").alias("tracks"), "dataset.task_count", "dataset.database_count",
        F.array_join("dataset.databases", ",").alias("databases"), "dataset.robustness_task_count", "dataset.balanced_110", F.col("upstream.available").alias("upstream"), F.col("upstream.catalog_matches_upstream").alias("matches"),
    )


@query("""SELECT 'degraded' AS status, true AS dataset, false AS upstream, count(*) AS task_count, (SELECT count(DISTINCT event_type) FROM events) AS databases, (SELECT count(DISTINCT (event_type, user_id)) FROM events) AS collections, 4 AS concurrency, false AS configured FROM labels""")
def health_document(spark, d):
    """The health document of a task file and an inventory of the kinds of events."""
    path = _documents(spark, d, tables.new_path(spark, "health"))
    held = table(spark, d, "events").select(F.col("event_type").alias("db"), F.col("user_id").cast("string").alias("collection")).distinct()
    doc = O.health(spark, path, load=lambda _: held)
    return doc.select("status", F.col("dataset.available").alias("dataset"), F.col("upstream.available").alias("upstream"), "dataset.task_count", F.col("databases.database_count").alias("databases"), F.col("databases.collection_count").alias("collections"), "defaults.concurrency", "provider.configured")
