import json
import os
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import taskmill
from taskmill import config, operators, plans, sources
from taskmill import functions as X

SF = "/root/testdata/sf0.001"


# A method that is there, and names of variants that are none.
KNOWN_METHODS, NO_METHODS = {"sag_v3", "react_informed"}, {"sag_card1", "sag_gate", "sag_v2"}


def test_method_relation(spark):
    rows = sources.methods(spark).orderBy("ord").collect()
    ids = [r.id for r in rows]
    assert len(set(ids)) == len(rows) == 10 and KNOWN_METHODS.issubset(ids) and NO_METHODS.isdisjoint(ids)
    assert sum(r.supports_self_consistency for r in rows) == 8 and [r.ord for r in rows] == list(range(10))
    assert [r.ord for r in operators.ids_of_family(sources.methods(spark)).orderBy("ord").collect()] == list(range(9))
    assert [(r.id, r.field) for r in sources.tracks(spark).orderBy("ord").collect()] == [("canonical", "NLQ"), ("robustness", "NLQ_colloquial")]


def test_summary_of_a_small_file(spark, tmp_path):
    rows = [{"db_id": k, "NLQ": "q", "NLQ_colloquial": c} for k, c in (("shop", "what"), ("bank", ""), ("shop", "who"), ("zoo", None), ("bank", "how"))]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    for strict in (True, False):
        row = operators.load_summary(spark, f"file://{tmp_path}/t.json", strict).first()
        assert (row.available, row.task_count, row.database_count, row.robustness_task_count, row.balanced_110, row.error) == (True, 5, 3, 3, False, None)
        assert row.databases == ["bank", "shop", "zoo"] and list(row.tasks_per_database.items()) == [("bank", 2), ("shop", 2), ("zoo", 1)]


def test_relaxed_reader_reports_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"db_id": "a"}, {"db_id": ')
    row = operators.load_summary(spark, str(tmp_path / "t.json"), strict=False).first()
    assert not row.available and row.error and row.task_count == 0 and row.databases is None


def test_remote_paths(spark, tmp_path):
    """A path that only Spark's file systems can open, as a remote store's."""
    (tmp_path / "t.json").write_text('[{"db_id": "a"}]')
    (tmp_path / "ids.json").write_text('["direct", "sql_pivot"]')
    spark.conf.set("fs.viewfs.mounttable.core.link./in", f"file://{tmp_path}")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.core.link./in", f"file://{tmp_path}")
    assert operators.load_summary(spark, "viewfs://core/in/t.json").first().task_count == 1
    assert not operators.load_summary(spark, "viewfs://core/in/none.json").first().available
    assert [r.id for r in sources.read_id_list(spark, "viewfs://core/in/ids.json").orderBy("ord").collect()] == ["direct", "sql_pivot"]


def test_other_failures_are_raised(spark, tmp_path, monkeypatch):
    """A failing executor is no unavailable file."""
    (tmp_path / "t.json").write_text("[]")

    def broken(*_):
        def run(batches):
            raise MemoryError("lost")
            yield

        return run

    monkeypatch.setattr(sources, "_parser", broken)
    with pytest.raises(Exception, match="lost"):
        operators.load_summary(spark, str(tmp_path / "t.json"))


@pytest.mark.parametrize("text, want", [('["a", "b"]', ["a", "b"]), ("3", []), ('{"a": 1}', []), ("null", []), ("[", []), ("", []), ("[1, null]", ["1", "None"])])
def test_id_lists(spark, tmp_path, text, want):
    (tmp_path / "ids.json").write_text(text)
    assert [r.id for r in sources.read_id_list(spark, str(tmp_path / "ids.json")).orderBy("ord").collect()] == want
    assert sources.read_id_list(spark, str(tmp_path / "none")).count() == 0 == sources.read_id_list(spark, str(tmp_path)).count()


def test_catalogue_compares_an_id_list(spark, tmp_path):
    ids = [r[1] for r in sorted((r.ord, r.id) for r in operators.ids_of_family(sources.methods(spark)).collect())]
    for listed, want in ((None, None), (ids, True), (ids[::-1], False), (ids[1:], False)):
        (tmp_path / "ids.json").write_text(json.dumps(listed))
        official = sources.read_id_list(spark, str(tmp_path / "ids.json"))
        up = operators.catalogue(spark, str(tmp_path / "none"), str(tmp_path), "0123abcd", official).first().upstream
        assert (up.catalog_matches_upstream, up.official_baseline_ids, up.available, up.commit) == (want, listed, True, "0123abcd")


def test_inventory_of_the_session_catalog(spark, tmp_path):
    name = f"shop{os.getpid()}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/shop'")
    try:
        spark.sql(f"CREATE TABLE {name}.orders (a INT) USING parquet")
        spark.range(1).createOrReplaceTempView("passing")
        rows = {(r.db, r.collection) for r in sources.inventory(spark).collect()}
        assert (name, "orders") in rows and not any(c == "passing" for _, c in rows)
        row = operators.catalog_health(spark).first()
        assert row.available and name in row.databases and row.databases == sorted(row.databases)
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_documents_as_json(spark, tmp_path):
    s = config.load({"TASKMILL_API_KEY": "a-secret", "TASKMILL_CONCURRENCY": "7"})
    shown = json.loads(operators.as_json(operators.defaults_document(spark, s)).first().json)
    assert shown == {"provider": "openai-compatible", "model": s.model, "reasoning_effort": s.reasoning_effort, "concurrency": 7, "api_key_configured": True}
    assert json.loads(operators.as_json(operators.identity_document(spark)).first().json) == {"name": "taskmill", "version": taskmill.__version__}
    operators.write_json(operators.health(spark, str(tmp_path / "none"), settings=s, load=lambda x: x.createDataFrame([("a", "t")], "db string, collection string")), str(tmp_path / "out"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    doc = json.loads(text)
    assert doc["status"] == "degraded" and doc["databases"]["databases"] == ["a"] and doc["provider"]["configured"] and "a-secret" not in text
    # What a missing data set does not have is left out.
    assert set(doc["dataset"]) == {"available", "path", "task_count", "database_count", "tasks_per_database"}
    listed = json.loads(operators.as_json(operators.catalogue(spark, str(tmp_path / "none"))).first().json)
    assert len(listed["methods"]) == 10 and [t["id"] for t in listed["tracks"]] == ["canonical", "robustness"]


def test_ordered_results(spark):
    """What is sorted comes sorted."""
    assert [r.db for r in plans.queries()["distinct_names"](spark, SF).collect()] == sorted(r.db for r in plans.queries()["distinct_names"](spark, SF).collect())
    keys = [r.db_key for r in plans.queries()["group_count_sorted"](spark, SF).collect()]
    assert keys == sorted(keys)
    row = operators.summarise(spark.createDataFrame([(k, True) for k in "zbabz"], "db_key string, has_colloquial boolean")).first()
    assert row.databases == ["a", "b", "z"] and list(row.tasks_per_database) == ["a", "b", "z"]


@pytest.mark.parametrize("raw", [b"", b"[{", b"[] x", b'{"db_id":1}\n{"db_id":2}', b"\xef\xbb\xbf[]", b"[{'db_id':'a'}]", b"\xff", b'{"a":1}', b"[1]", b"/**/[]", b"3"])
def test_unreadable_files(spark, tmp_path, raw):
    (tmp_path / "t.json").write_bytes(raw)
    row = operators.load_summary(spark, str(tmp_path / "t.json")).first()
    assert not row.available and row.error and row.task_count == 0 and row.databases is None and row.balanced_110 is None


def test_missing_file_and_directory(spark, tmp_path):
    for path in (tmp_path / "none.json", tmp_path):
        row = operators.load_summary(spark, str(path)).first()
        assert not row.available and row.error is None and row.tasks_per_database == {}


def test_strict_keys_and_flags():
    keys = [x[1] for x in sources.parse_tasks(b'[{"db_id":null},{"db_id":""},{"db_id":0},{"db_id":false},{"db_id":[]},{"db_id":{}},{},{"db_id":true},{"db_id":1.50},{"db_id":[1, 2]},{"db_id":" "},{"DB_ID":"a"},{"db_id":"a","db_id":"b"},{"db_id":NaN}]')]
    assert keys == ["unknown"] * 7 + ["True", "1.5", "[1, 2]", " ", "unknown", "b", "nan"]
    assert [x[2] for x in sources.parse_tasks(b'[{"NLQ_colloquial":" "},{"NLQ_colloquial":""},{"NLQ_colloquial":0},{"NLQ_colloquial":"0"},{"NLQ_colloquial":null}]')] == [True, False, False, True, False]
    assert sources.parse_tasks(b"{}") == [] == sources.parse_tasks(b"[]")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({}, optional={"db_id": st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=3)), "NLQ_colloquial": st.one_of(st.none(), st.text(max_size=2), st.integers(0, 1))}), max_size=8))
def test_summary_equals_a_plain_fold(spark, tmp_path, rows):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(rows), encoding="utf-8")
    count = Counter(str(r.get("db_id") or "unknown") for r in rows)
    row = operators.load_summary(spark, str(path)).first()
    assert row.available and row.task_count == len(rows) and row.tasks_per_database == dict(count) and row.databases == sorted(count)
    assert row.robustness_task_count == sum(bool(r.get("NLQ_colloquial")) for r in rows)


def test_balance(spark):
    rows = lambda a, b: spark.createDataFrame([("x", True)] * a + [("y", False)] * b, "db_key string, has_colloquial boolean")
    assert operators.summarise(rows(110, 110)).first().balanced_110 is True
    assert operators.summarise(rows(110, 109)).first().balanced_110 is False
    row = operators.summarise(rows(1, 1).limit(0)).first()
    assert (row.task_count, row.database_count, row.databases, row.balanced_110) == (0, 0, [], False)


def test_order_matters(spark):
    ids = lambda *x: spark.createDataFrame(list(enumerate(x)), "ord int, id string")
    want = ids("a", "b")
    assert [operators.matches_in_order(x, want).first()[0] for x in (ids(), ids("a", "b"), ids("b", "a"), ids("a"))] == [None, True, False, False]


def test_inventory_health_and_workload(spark, tmp_path):
    rows = spark.createDataFrame([("admin", "x"), ("config", "x"), ("local", "x"), ("b", "t"), ("b", "u"), ("a", None), (None, "z")], "db string, collection string")
    row = operators.inventory_summary(rows).first()
    assert (row.databases, row.database_count, row.collection_count) == (["a", "b"], 2, 2)

    def broken(_):
        raise sources.CatalogError("no answer")

    assert operators.catalog_health(spark, broken).first().message == "no answer"
    path = tmp_path / "t.json"
    path.write_text("[]")
    for there, load, want in ((str(tmp_path), lambda s: rows, "ready"), (None, lambda s: rows, "degraded"), (str(tmp_path), broken, "degraded")):
        doc = operators.health(spark, str(path), there, load=load).first()
        assert doc.status == want
    doc = operators.catalogue(spark, str(tmp_path / "none"), None, None).first()
    assert len(doc.methods) == 10 and len(doc.tracks) == 2 and not doc.dataset.available and doc.upstream.catalog_matches_upstream is None
    m, t = sources.methods(spark), sources.tracks(spark)
    assert [operators.planned_workload(m.limit(2), t.limit(1), n).first()[0] for n in (None, 1210, 0)] == [2420, 2420, 0]


def test_expressions(spark):
    row = spark.range(1).select(X.toggled(F.array(F.lit("x"), F.lit("y")), F.lit("x")).alias("a"), X.toggled(F.array(F.lit("y")), F.lit("x")).alias("b"), X.short_commit(F.lit(None).cast("string")).alias("c"), X.short_commit(F.lit("0123456789")).alias("d"), X.thousands(F.lit(1210)).alias("e"), X.has_secret(F.lit("your-key")).alias("f"), X.has_secret(F.lit(None).cast("string")).alias("g"), X.status_label(F.lit("degraded")).alias("h")).first()
    assert tuple(row) == (["y"], ["y", "x"], "Not connected", "01234567", "1,210", False, False, "Checking system")


def test_settings(tmp_path):
    s = config.load({"TASKMILL_API_KEY": "secret-value", "TASKMILL_SOURCE_DIR": str(tmp_path), "OTHER": "x"})
    assert s.api_key_configured and "secret-value" not in repr(s) and s.model == config.MODEL and s.source_dir == str(tmp_path)
    assert not config.load({"TASKMILL_API_KEY": "your-key"}).api_key_configured and not config.load({}).api_key_configured
    s = config.load({"TASKMILL_RELEASE_DIR": "rel/../v1"}, root=str(tmp_path))
    assert (s.dataset_path, s.runtime_dir) == (f"{tmp_path}/v1/data/tasks.json", f"{tmp_path}/data/runtime")
    for bad in ("0", "129", "x"):
        with pytest.raises(ValueError):
            config.load({"TASKMILL_CONCURRENCY": bad})
    (tmp_path / ".env").write_text("# c\nTASKMILL_MODEL='m'\nTASKMILL_CONCURRENCY=8\n")
    s = config.load({"TASKMILL_CONCURRENCY": "9"}, str(tmp_path / ".env"))
    assert (s.model, s.concurrency) == ("m", 9)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plans.queries()[name](spark, SF)
    want = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(map(key, want.fetchall())) == Counter(key(r) for r in got.select(*names).collect())


def test_progress_streams(spark, tmp_path):
    from taskmill.streaming import progress

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM progress").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
