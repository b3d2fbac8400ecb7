import random
import statistics as plain
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taskmill.operators import filters, releases
from taskmill.operators import statistics as Q

RESULTS = "method string, task string, score double"


# ---------------------------------------------------------------- bootstrap


def test_weights_are_poisson_and_paired(spark):
    w = spark.range(20_000).select("id", Q.poisson_weights(F.col("id"), 20).alias("w"))
    flat = [x for r in w.collect() for x in r.w]
    assert plain.mean(flat) == pytest.approx(1, abs=0.01) and plain.variance(flat) == pytest.approx(1, abs=0.02)
    assert Counter(flat)[0] / len(flat) == pytest.approx(0.36788, abs=0.003)
    again = {r.id: r.w for r in spark.range(50).repartition(3).select("id", Q.poisson_weights(F.col("id"), 20).alias("w")).collect()}
    assert again == {r.id: r.w for r in w.filter("id < 50").collect()}
    other = spark.range(50).select(Q.poisson_weights(F.col("id"), 20, "1").alias("w")).collect()
    assert [r.w for r in other] != [again[i] for i in range(50)]


def test_interval_covers_the_mean(spark):
    """Of 80 samples of a known mean, the 90 % intervals hold it in about 90 %."""
    made = random.Random(1)
    rows = [(f"m{m}", f"{m}-{i}", made.gauss(5, 2)) for m in range(80) for i in range(150)]
    got = Q.bootstrap(spark.createDataFrame(rows, RESULTS), replicates=200, level=0.9).collect()
    held = sum(r.low <= 5 <= r.high for r in got)
    assert 64 <= held <= 79
    for r in got:
        mine = [s for m, _, s in rows if m == r.method]
        assert r.n == 150 and r.mean == pytest.approx(plain.mean(mine))
        assert (r.high - r.low) / 2 == pytest.approx(1.645 * plain.stdev(mine) / 150**0.5, rel=0.35)


def test_paired_differences(spark):
    """A method that is always a little better: its mean's interval is wide, that of the difference is not."""
    made = random.Random(2)
    base = [(f"t{i}", made.gauss(0, 10)) for i in range(200)]
    rows = [("a", t, s) for t, s in base] + [("b", t, s + 0.5) for t, s in base] + [("b", "t1", None), (None, "t1", 3.0), (None, None, 5.0)]
    got = {r.method: r for r in Q.bootstrap(spark.createDataFrame(rows, RESULTS), baseline="a").collect()}
    assert got["b"].diff_low == pytest.approx(0.5) == got["b"].diff_high and got["b"].high - got["b"].low > 1
    assert (got["a"].diff, got["a"].diff_low, got["a"].n, got["b"].n, got[None].n, got[None].mean) == (0, 0, 200, 200, 2, 4)
    assert Q.bootstrap(spark.createDataFrame([], RESULTS)).count() == 0


# ---------------------------------------------------------------- subtotals, sketches


def test_report_tells_nulls_from_totals(spark):
    rows = [("a", "x", 1.0), ("a", None, 3.0), ("b", "x", None)]
    got = {(r.method, r.task, r.level): (r.n, r.avg_score) for r in Q.report(spark.createDataFrame(rows, RESULTS), ("method", "task"), ("score",)).collect()}
    assert got == {("a", "x", 0): (1, 1), ("a", None, 0): (1, 3), ("b", "x", 0): (1, None), ("a", None, 1): (2, 2), ("b", None, 1): (1, None), (None, "x", 2): (2, 1), (None, None, 2): (1, 3), (None, None, 3): (3, 2)}
    plan = Q.report(spark.createDataFrame(rows, RESULTS), ("method", "task"), ("score",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1


@pytest.mark.parametrize("n", [1, 500, 200_000])
def test_sketches_merge_within_their_bounds(spark, n):
    rows = spark.range(n * 2).select((F.col("id") % 9).alias("day"), F.lit("k").alias("key"), (F.col("id") % n).alias("user"), ((F.col("id") * 7919 % 10007) ** 2 * 1.0).alias("v"))
    rows = rows.unionByName(rows.limit(1).select("day", F.lit("none").alias("key"), F.lit(None).cast("long").alias("user"), F.lit(None).cast("double").alias("v")))
    days = Q.sketches(rows, ["key", "day"], "user", "v")
    got = {r.key: r for r in Q.estimates(Q.merged(days, ["key"]), ["key"], (0.1, 0.5, 0.9)).collect()}
    assert got["k"].n == 2 * n and abs(got["k"].distinct - n) <= max(1, n * Q.DISTINCT_ERROR)
    values = sorted(r.v for r in rows.filter("key = 'k'").collect())
    for q, found in zip((0.1, 0.5, 0.9), got["k"].quantiles, strict=True):
        below, upto = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
        assert below - Q.RANK_ERROR <= q <= upto + Q.RANK_ERROR
    assert (got["none"].n, got["none"].distinct, got["none"].quantiles) == (1, 0, None)


# ---------------------------------------------------------------- releases


def test_release_diff(spark):
    kind = "id string, a string, b int"
    old = [("same", "x", 1), ("twice", "x", 1), ("gone", "x", 1), ("new a", "x", 1), ("new b", None, 1), ("both", "x", 1), ("both", "y", 2), (None, "n", 1), ("less", "x", 1), ("less", "x", 1), ("null", None, None)]
    new = [("same", "x", 1), ("twice", "x", 1), ("twice", "x", 1), ("come", "x", 1), ("new a", "z", 1), ("new b", "x", None), ("both", "x", 1), ("both", "y", 3), (None, "m", 1), ("less", "x", 1), ("null", None, None)]
    got = {r.id: (r.n_old, r.n_new, r.change, r.fields) for r in releases.release_diff(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), "id").collect()}
    assert got == {
        "same": (1, 1, "same", None), "twice": (1, 2, "repeated", None), "gone": (1, 0, "removed", None), "come": (0, 1, "added", None), "new a": (1, 1, "changed", ["a"]), "new b": (1, 1, "changed", ["a", "b"]),
        "both": (2, 2, "changed", None), None: (1, 1, "changed", ["a"]), "less": (2, 1, "repeated", None), "null": (1, 1, "same", None),
    }
    # A column that one release has not, a hot key, and no rows.
    wider = releases.release_diff(spark.createDataFrame([("k", "x", 1)], kind), spark.createDataFrame([("k", "x", 1, 5.0)], kind + ", c double"), "id").first()
    assert (wider.change, wider.fields) == ("changed", ["c"])
    hot = spark.range(5000).select(F.lit("hot").alias("id"), (F.col("id") % 50).cast("string").alias("a"), F.lit(1).alias("b"))
    assert releases.release_diff(hot, hot.unionByName(hot), "id").first().change == "repeated"
    assert releases.release_diff(hot.limit(0), hot.limit(0), "id").count() == 0


# ---------------------------------------------------------------- filter documents

DOCS = [(1, "a", '{"n": 5, "s": "5", "t": true, "l": [1, {"x": "y"}], "o": {"p": {"q": -1.5}}, "z": null, "we ird": 1}'), (2, "b", '{"n": "5", "s": 5, "l": []}'), (3, None, '{"n": 7.5, "o": {"p": 3}}'), (4, "d", "not json"), (5, "e", None), (6, "f", "[1, 2]"), (7, "g", "{}")]
CASES = [
    ({}, {1, 2, 3, 4, 5, 6, 7}), ({"n": 5}, {1}), ({"n": "5"}, {2}), ({"n": {"$gt": 4}}, {1, 3}), ({"n": {"$gte": 5, "$lt": 7}}, {1}), ({"n": {"$lt": "6"}}, {2}), ({"t": True}, {1}), ({"t": 1}, set()), ({"n": {"$ne": 5}}, {2, 3, 4, 5, 6, 7}),
    ({"z": None}, {1, 2, 3, 4, 5, 6, 7}), ({"n": None}, {4, 5, 6, 7}), ({"z": {"$exists": True}}, {1}), ({"n": {"$exists": False}}, {4, 5, 6, 7}), ({"o.p.q": {"$lt": 0}}, {1}), ({"l.1.x": "y"}, {1}), ({"l.0": 1}, {1}), ({"l": {"$size": 0}}, {2}), ({"l": {"$size": 2}}, {1}),
    ({"n": {"$in": [5, "5", 9]}}, {1, 2}), ({"n": {"$in": []}}, set()), ({"n": {"$in": [None, 7.5]}}, {3, 4, 5, 6, 7}), ({"n": {"$nin": [5, 7.5]}}, {2, 4, 5, 6, 7}), ({"s": {"$regex": "^[0-9]$"}}, {1}), ({"n": {"$not": {"$gt": 4}}}, {2, 4, 5, 6, 7}),
    ({"$or": [{"n": 5}, {"name": "b"}]}, {1, 2}), ({"$and": [{"n": {"$gt": 1}}, {"o.p": {"$exists": True}}]}, {1, 3}), ({"$nor": [{"n": 5}, {"name": None}]}, {2, 4, 5, 6, 7}), ({"$or": []}, set()), ({"$and": []}, {1, 2, 3, 4, 5, 6, 7}), ({"name": {"$gte": "d"}, "id": {"$lt": 6}}, {4, 5}),
    ({"id": "1"}, set()), ({"we ird": 1}, {1}), ({"$or": [{"$and": [{"id": 7}, {"$nor": [{"n": 1}]}]}, {"id": {"$in": [2, 3]}, "n": {"$exists": True}}]}, {2, 3, 7}), ({"name": {"$exists": True}}, {1, 2, 3, 4, 5, 6, 7}), ({"name": {"$size": 1}}, set()),
]


@pytest.mark.parametrize("query, want", CASES)
def test_filters(spark, query, want):
    df = spark.createDataFrame(DOCS, "id long, name string, doc string")
    assert {r.id for r in filters.matching(df, query, "doc").collect()} == want


@pytest.mark.parametrize("query", [{"$where": "1"}, {"n": {"$near": 1}}, {"n": {"$in": 5}}, {"$or": {"n": 1}}, {"n": [1]}, {"a']['b": 1}, {"": 1}, [], {"n": {"$not": {"$bad": 1}}}])
def test_filters_without_meaning(spark, query):
    with pytest.raises(filters.FilterError):
        filters.matching(spark.createDataFrame(DOCS, "id long, name string, doc string"), query, "doc")


def test_filters_on_columns_reach_the_scan(spark):
    df = filters.matching(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), {"event_type": "click", "value": {"$gt": 3}, "k": 5}, "props")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :][:200]
    assert "EqualTo(event_type,click)" in pushed and "GreaterThan(value,3.0)" in pushed
