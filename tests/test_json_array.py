import json
import os
import random

import pytest

from taskmill import operators, sources
from taskmill.sources import json_array


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


ODD = ["}", "{", "[", "]", ",", '"', "\\", "\\\\", '\\"', "},{", "é", "漢", "\n", "😀", "a", " ", "u0041", " ", "/"]


def odd_tasks(seed, n):
    """Objects whose texts and keys hold every mark that the scanner looks for."""
    made = random.Random(seed)
    text = lambda: "".join(made.choice(ODD) for _ in range(made.randrange(12)))
    value = lambda depth: made.choice([text, lambda: made.randrange(9), lambda: None, lambda: True, lambda: [value(depth - 1) for _ in range(made.randrange(3))] if depth else [], lambda: {text(): value(depth - 1)} if depth else {}])()
    rows = [{"db_id": made.choice([text(), None, 0, [1, 2], "shop"]), text(): value(3), "NLQ_colloquial": made.choice([text(), None])} for _ in range(n)]
    rows[n // 2:n // 2] = [{"db_id": "long", "x": ["}" * 1500, {"y": "," * 900}]}]  # an element over several ranges
    return rows


@pytest.mark.parametrize("seed, shape", [(1, {}), (2, {"indent": 2}), (3, {"separators": (",", ":"), "ensure_ascii": False})])
def test_ranges_give_the_rows_of_the_plain_parser(spark, tmp_path, small_ranges, seed, shape):
    raw = (" \n" + json.dumps(odd_tasks(seed, 120), **shape) + "\t\n").encode()
    (tmp_path / "t.json").write_bytes(raw)
    arrays = json_array.scan(spark, str(tmp_path / "t.json"))
    assert len(arrays.starts) > 20 and list(arrays.elements.values()) == [121]
    got = sorted(tuple(r) for r in sources.read_tasks(spark, str(tmp_path / "t.json")).collect())
    assert got == [(*r, None) for r in sources.parse_tasks(raw)]


BROKEN = [
    lambda t: t[:-1], lambda t: t + "]", lambda t: t + " {}", lambda t: t[:-1] + ",]", lambda t: "[," + t[1:], lambda t: t[1:], lambda t: "[" + t, lambda t: t[: len(t) // 2],
    lambda t: t[: len(t) // 2] + '"' + t[len(t) // 2 :], lambda t: t.replace('"db_id"', "'db_id'", 1), lambda t: t[:-1] + ", 7]", lambda t: t + t, lambda t: t.replace("}, {", "} {", 1), lambda t: t.replace("}, {", "},, {", 1), lambda t: "{" + t[1:-1] + "}",
    lambda t: '{"a": ' + t + "}", lambda t: "﻿" + t, lambda t: t[:-1] + ", null]", lambda t: "//\n" + t, lambda t: t + ",", lambda t: t + "}",
]


@pytest.mark.parametrize("case", range(len(BROKEN)))
def test_broken_files_over_ranges(spark, tmp_path, small_ranges, case):
    raw = BROKEN[case](json.dumps([{"db_id": f"k{i}", "NLQ_colloquial": "x" * (i % 7)} for i in range(60)])).encode()
    (tmp_path / "t.json").write_bytes(raw)
    with pytest.raises(sources.TaskFileError):
        sources.parse_tasks(raw)
    row = operators.load_summary(spark, str(tmp_path / "t.json")).first()
    assert not row.available and row.error and row.task_count == 0


def test_bytes_that_are_no_text(spark, tmp_path, small_ranges):
    text = json.dumps([{"db_id": f"k{i}"} for i in range(60)]).encode()
    (tmp_path / "t.json").write_bytes(text[:400] + b"\xff" + text[400:])
    assert operators.load_summary(spark, str(tmp_path / "t.json")).first().error
    (tmp_path / "t.json.gz").write_bytes(__import__("gzip").compress(text))
    assert operators.load_summary(spark, str(tmp_path / "t.json.gz")).first().error


@pytest.mark.parametrize("text, n", [("[]", 0), (" [ ] ", 0), ("{}", 0), (" { }\n", 0), ("[{}]", 1), ("[{},{}]", 2), ('[{"db_id":"a"}]}', None), ("[{}", None), ("{", None), ("[", None), ("   ", None), ("}", None), ("[}", None), ("[{}}]", None), ('["a"]', None), ("[[]]", None)])
def test_small_arrays(spark, tmp_path, text, n):
    (tmp_path / "t.json").write_text(text)
    row = operators.load_summary(spark, str(tmp_path / "t.json")).first()
    assert (row.available, row.task_count if row.available else None) == (n is not None, n)


def test_many_ranges_and_half_a_surrogate(spark, tmp_path):
    """A file of some MB at Spark's usual way of dealing, and a key that no Spark string can hold."""
    n = 60_000
    path = tmp_path / "t.json"
    path.write_text("[" + ",".join(f'{{"db_id": "db{i % 11}", "NLQ_colloquial": "{"q" * (i % 50)}"}}' for i in range(n)) + ',{"db_id": "\\ud800"}]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        rows = sources.read_tasks(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4 and os.path.getsize(path) > 3e6
        assert sorted(r.ord for r in rows.collect()) == list(range(n + 1))
        row = operators.load_summary(spark, str(path)).first()
        assert row.task_count == n + 1 and row.tasks_per_database["?"] == 1 and row.robustness_task_count == n - n // 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_of_arrays(spark, tmp_path, small_ranges):
    rows = odd_tasks(5, 90)
    for i in range(3):
        (tmp_path / f"t{i}.json").write_text(json.dumps(rows[i * 30 : i * 30 + 30]))
    (tmp_path / "t4.json").write_bytes(b"\xef\xbb\xbf[]")
    got = sources.read_task_files(spark, str(tmp_path)).collect()
    for i in range(3):
        mine = sorted(tuple(r)[1:] for r in got if r.file.endswith(f"t{i}.json"))
        assert mine == [(*r, None) for r in sources.parse_tasks((tmp_path / f"t{i}.json").read_bytes())]
    assert sorted((r.file[-7:], r.error.split()[-1], r.ord) for r in got if r.error) == [("t4.json", "compressed", None)]


def test_written_arrays_are_read_again(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('k', id % 7)) AS db_id", "if(id % 2 = 0, '}\\n,', '') AS NLQ_colloquial").repartition(3)
    json_array.write_arrays(df, str(tmp_path / "out"))
    for name in os.listdir(tmp_path / "out"):
        if name.startswith("part"):
            assert len(json.loads((tmp_path / "out" / name).read_text())) > 100
    got = sources.read_task_files(spark, str(tmp_path / "out"))
    assert got.filter("error IS NOT NULL").isEmpty()
    assert {r.db_key: r.n for r in operators.group_count(got).collect()} == {r.k: r.n for r in df.selectExpr("coalesce(db_id, 'unknown') AS k").groupBy("k").agg({"*": "count"}).toDF("k", "n").collect()}
    assert got.filter("has_colloquial").count() == 500
    json_array.write_arrays(df.limit(0), str(tmp_path / "none"))
    assert sources.read_task_files(spark, str(tmp_path / "none")).count() == 0
